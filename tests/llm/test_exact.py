import hashlib
import re
from collections import defaultdict

import numpy as np

from isohyet.llm import exact


def plain(text):
    return re.sub("[\x20\x09-\x0D]", "", text or "")


def test_groups_match_brute_force(table, messy):
    got = exact.exact_groups(table(messy, extra=True), bits=4).collect()
    assert len(got) == len(messy)
    groups = defaultdict(list)
    for doc_id, text in messy:
        groups[plain(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    keep = {hashlib.sha256(p.encode()).hexdigest(): (min(g)[3], len(g)) for p, g in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == keep[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(keep)


def test_one_row_of_each_group_stays_with_all_columns(table, messy):
    docs = table(messy, extra=True)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [plain(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({plain(t) for _, t in messy})


def test_empty_table(table):
    assert exact.exact_groups(table([])).count() == 0
    assert exact.exact_dedup(table([])).count() == 0


def test_filter_counts_and_loses_nothing():
    values = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    values = np.concatenate([values, values[:100], values[:10]])
    quotients, bounds, remainders, counts = exact.filter_of(values, np.ones(len(values), np.int64), 6)
    whole = np.repeat(quotients << np.uint64(58), np.diff(bounds)) | remainders
    want, n = np.unique(values, return_counts=True)
    assert (whole == want).all() and (counts == n).all()


def test_partitions_merge(spark):
    values = [(i % 700,) for i in range(1000)]
    fps = spark.createDataFrame(values, "k int").selectExpr("xxhash64(k) AS fp", "k").repartition(7)
    often = {r.fp for r in exact.repeated_fingerprints(fps, 5).collect()}
    assert often == {r.fp for r in fps.filter("k < 300").collect()}

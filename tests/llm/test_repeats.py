import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.llm import repeats, substring, suffixes, text
from isohyet.llm.text import word_hashes


def covered(sequences, window):
    count = Counter(tuple(s[i:i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        mask = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i:i + window])] > 1:
                mask[i:i + window] = [True] * window
        out.append(mask)
    return out


def key(doc_id, *values):
    return (doc_id is None, doc_id or 0, *values)


@pytest.mark.parametrize(("window", "group"), [(35, 1500), (12, 1500), (12, 0), (4, 2)])
def test_words_match_brute_force(table, messy, window, group):
    got = substring.remove_repeated_words(table(messy, extra=True), window, group).collect()
    words = [(t or "").encode().split() for _, t in messy]
    want = []
    for (doc_id, _), ws, mask in zip(messy, words, covered(words, window), strict=True):
        kept = b" ".join(w for w, m in zip(ws, mask, strict=True) if not m).decode()
        want.append(key(doc_id, len(ws), sum(mask), kept))
    assert sorted(key(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize(("window", "group"), [(400, 1500), (90, 1500), (90, 1), (7, 3)])
def test_bytes_match_brute_force(table, messy, window, group):
    got = suffixes.remove_repeated_bytes(table(messy, extra=True), window, group).collect()
    texts = [(t or "").encode() for _, t in messy]
    want = []
    for (doc_id, _), text, mask in zip(messy, texts, covered(texts, window), strict=True):
        kept = bytes(b for b, m in zip(text, mask, strict=True) if not m)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        want.append(key(doc_id, len(text), sum(mask), spans, kept))
    assert sorted(key(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


def test_prefix_doubling_finds_the_same_windows(table, messy):
    rows = [(i, t) for i, (_, t) in enumerate(messy) if t and len(t) < 2000]
    texts = [t.encode() for _, t in rows]
    count = Counter(t[i:i + 70] for t in texts for i in range(len(t) - 69))
    want = {(d, i) for (d, _), t in zip(rows, texts, strict=True) for i in range(len(t) - 69) if count[t[i:i + 70]] > 1}
    assert {(r.doc_id, r.p) for r in suffixes.doubled(table(rows), 70, 20).collect()} == want


def test_long_text_in_pieces(table):
    words = [f"v{i * 7919 % 100003}" for i in range(150_000)]  # longer than a piece
    passage = words[131_000:131_200]  # across the cut
    rows = [(1, " ".join(words)), (2, " ".join(["q"] + passage + ["z"]))]
    a, b = sorted(substring.remove_repeated_words(table(rows), 35).collect())
    masks = covered([words, rows[1][1].split()], 35)
    assert (a.n_removed, b.n_removed) == (sum(masks[0]), sum(masks[1]))


def test_empty_table_and_digests(table, messy):
    assert substring.digest(table([])).count() == 0 and suffixes.digest(table([])).count() == 0
    r = substring.digest(table([(1, None)])).first()
    assert (r.n_words, r.n_removed, r.kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())


def test_equal_words_have_equal_hashes_across_slices():
    texts = [b"a bb  ccc", None, b"", b"bb\x0bccc\x0c", b" ".join(b"w%d" % i for i in range(900))]
    whole, cut = word_hashes(texts), word_hashes(texts, size=16)
    assert [len(x) for x in whole] == [3, 0, 0, 2, 900]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert whole[0][1] == whole[3][0] and whole[0][2] == whole[3][1]


def test_sliding_minimum():
    x = np.random.default_rng(2).integers(0, 99, 200)
    for width in (1, 2, 7, 64):
        want = [x[i:i + width].min() for i in range(len(x) - width + 1)]
        assert repeats.sliding_min(x, width).tolist() == want


def test_words_built_to_collide_are_not_repeats(table):
    bits = [bin(i).count("1") % 2 for i in range(512)]
    x, y = ("".join(pair[b] for b in bits) for pair in ("ab", "ba"))
    before = " ".join(f"w{i}" for i in range(34))
    rows = substring.digest(table([(1, f"{before} {x}"), (2, f"{before} {y}")])).collect()
    assert [r.n_removed for r in rows] == [0, 0]


def test_bytes_built_to_collide_are_not_repeats(table):
    letters = "".join("':"[bin(i).count("1") % 2] for i in range(256))  # a Thue-Morse sequence, far right its complement
    swapped = letters.translate(str.maketrans("':", ":'"))
    between = ("hsreltpuscta pirhgwpr rpmuehueqmxavycfysbjya iptxmwznmxzsoeldbepgivnyujnq "
               "mslrsnshkvaitvwfwkrssdwugu sijdcpupclzcneajnyndbttybmw")  # has the anchor of all windows
    rows = suffixes.digest(table([(1, letters + between + swapped), (2, swapped + between + letters)])).collect()
    assert [(r.n_bytes, r.n_removed) for r in rows] == [(640, 0)] * 2


def test_prime_hashes_are_polynomials_modulo_a_prime():
    symbols = np.random.default_rng(4).integers(0, 1 << 64, 9000, dtype=np.uint64)
    symbols[:3] = [0, text.PRIME, (1 << 64) - 1]
    base = text.drawn_base()
    hashes = text.PrimeHash(symbols, base)
    start = np.array([0, 1, 4090, 8000])
    want = [sum(int(x) * pow(base, i, text.PRIME) for i, x in enumerate(symbols[a:a + 400])) % text.PRIME for a in start]
    assert hashes.rolling(400)[start].tolist() == hashes.of(start, start + 400).tolist() == text.mix(np.array(want, np.uint64)).tolist()


def test_rows_of_a_frequent_path_are_dealt_out(table, monkeypatch):
    spark = table([]).sparkSession
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    paths = spark.range(20_500).selectExpr("id AS doc_id", "id AS th", "id AS place", "1L AS ak", "least(greatest(id, 19999), 20100) AS path")
    repeated = spark.sql("SELECT 1L AS ak, * FROM VALUES (19999L, 20000L), (20100L, 400L) AS t(path, n)")

    def largest():
        found = repeats.of_repeated(paths, repeated).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
        sizes = [r.n for r in found.collect()]
        assert sum(sizes) == 20_400
        return max(sizes)

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert largest() <= 10_000
        monkeypatch.setattr(repeats, "FREQUENT", 1 << 40)
        assert largest() >= 20_000  # as it was
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

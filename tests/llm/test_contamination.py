import hashlib
import re

import pytest

from isohyet.llm import contamination

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away home"), (2, "Short Item"), (3, None), (4, "!!"), (10, "über naïve x"),
         (2, "short item"), (5, "brown fox jumps over the lazy dog and runs away"), (None, "nameless words here")]
DOCS = [(1, "well, THE quick-brown fox jumps over the lazy dog and runs away."), (2, "a short item, short item!"), (3, None), (4, ""),
        (5, "nothing at all"), (6, "ÜBER naïve über naïve x"), (7, "über naïve x " * 50), (None, "nameless words here"), (8, "nameless words"),
        (5, "nothing at all"), (9, "quick brown fox jumps over the lazy dog and walks")]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n):
    out = []
    for doc_id, text in docs:
        ws = words(text)
        hit, names, unnamed = set(), set(), False
        for item, t in items:
            own = words(t)
            size = min(n, len(own))
            for i in range(len(own) - size + 1 if own else 0):
                for j in range(len(ws) - size + 1):
                    if ws[j:j + size] == own[i:i + size]:
                        hit |= set(range(j, j + size))
                        names |= {str(item)} if item is not None else set()
                        unnamed |= item is None
        out.append((str(doc_id), len(ws), len(hit), len(names) + unnamed,
                    hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture()
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("n", [3, 10])
def test_hits_match_brute_force(table, messy, bench, n, monkeypatch):
    docs = [*DOCS, *messy]
    real = contamination.benchmark_hits
    monkeypatch.setattr(contamination, "benchmark_hits", lambda d, b: real(d, b, n))
    got = contamination.digest(table(docs, extra=True), bench).collect()
    assert sorted((str(r.doc_id), *list(r)[1:]) for r in got) == brute(docs, ITEMS, n)


def test_blocks_agree_with_one_broadcast(table, bench):
    whole, cut = (sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.n_items) for r in
                         contamination.benchmark_hits(table(DOCS), bench, 10, size).collect()) for size in (1 << 20, 40))
    assert whole == cut


def test_clean_documents_stay_as_they_are(table, bench):
    docs = table(DOCS, extra=True)
    for size in (1 << 20, 40):
        clean = contamination.decontaminate(docs, bench, 10, size)
        assert clean.columns == docs.columns
        assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 5, 8, 9]


def test_empty_tables(table, bench):
    assert contamination.digest(table([]), bench).count() == 0
    assert not contamination.digest(table(DOCS), bench.limit(0)).filter("contaminated").count()

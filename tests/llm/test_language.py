import zlib

import numpy as np

from isohyet.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    unseen = [r.lang_pred == r.lang for r in rows if r.held_out and r.lang]
    assert len(unseen) > 200 and np.mean(unseen) > 0.97


def test_lookups_equal_the_convolution():
    rnd = np.random.default_rng(3)
    kernels = [rnd.normal(size=(w, language.EMBEDDED, 3)) for w in language.WIDTHS]
    net = language.Network(["a", "b"], rnd.normal(size=(256, language.EMBEDDED)), kernels, rnd.normal(size=(9, 2)), rnd.normal(size=2))
    windows = rnd.integers(0, 256, (5, 20)).astype(np.uint8)
    want = []
    for w in windows:
        e = net.embed[w]
        pooled = [max(sum(e[i + j] @ k[j][:, f] for j in range(len(k))) for i in range(20 - len(k) + 1)) for k in kernels for f in range(3)]
        want.append(pooled)
    assert np.allclose(net.pooled(windows, net.tables()), want, atol=1e-4)


def test_training_reads_every_window():
    """The languages differ between four evenly spread windows of ten alone."""
    texts = {c: b"".join((b"x" if i % 3 == 0 else c) * 16 for i in range(10)) for c in (b"a", b"b")}
    net = language.train([texts[c] for c in (b"a", b"b")] * 20, ["a", "b"] * 20, 16, 4, epochs=30)
    windows = np.array([np.frombuffer(c * 16, np.uint8) for c in (b"a", b"b")])
    got = net.probabilities(windows, net.tables())
    assert got[0, 0] > 0.9 and got[1, 1] > 0.9


def test_windows_cover_the_whole_text():
    windows, owner, sizes = language.windows_of([b"a" * 300, b"", b"bc"], 128)
    assert owner.tolist() == [0, 0, 0, 1, 2] and sizes.tolist() == [128, 128, 44, 1, 2]
    assert bytes(windows[4][:3]) == b"bc\0"


def test_odd_rows(table, messy):
    rows = [(i, t, ("xx", "yy", None)[k % 3]) for k, (i, t) in enumerate(messy)]
    got = language.languages(table(rows, extra=True), sample=5).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"xx", "yy", "und"}
    nothing = language.languages(table([(i, t) for i, t in messy])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == len(messy)
    assert language.languages(table([])).count() == 0

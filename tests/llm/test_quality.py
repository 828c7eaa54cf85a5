import re
import zlib

import numpy as np

from isohyet.llm import quality


def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    rows = quality.digest(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out]
    good = [r.predicted for r in unseen if r.quality == 1]
    bad = [r.predicted for r in unseen if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_held_out_labels_are_never_read(spark):
    docs, labels = tables(spark)
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels, sample=150), quality.fit(docs, turned, sample=150)
    assert (a.weights == b.weights).all() and a.intercept == b.intercept


def test_score_is_a_sparse_dot_product():
    model = quality.Model(np.random.default_rng(0).normal(size=1 << 10).astype(np.float32), 0.3, 10)
    text = "Ab cd, cd!! ünd 7x ab".encode()
    pieces = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text)
    columns, values = quality.features(text, 10)
    assert len(quality.ngrams(text, 10)) == 2 * len(pieces) - 1
    want = 1 / (1 + np.exp(-(0.3 + float(model.weights[columns] @ values))))
    assert abs(model.scores([text])[0] - want) < 1e-6


def test_long_texts_train_on_all_their_ngrams():
    text = " ".join(f"w{i}" for i in range(9000)).encode()
    columns, values = quality.features(text, 18)
    assert set(columns) == set(quality.ngrams(text, 18)) and abs(values.sum() - quality.SCALE) < 1e-9


def test_odd_rows(spark, table, messy):
    docs = table(messy, extra=True)
    labels = spark.createDataFrame([(i, q, 0) for i, q in ((4, 1), (5, 1), (6, 0), (None, 1), (7, None), (20, 1), (20, 0), (999, 1))],
                                   "doc_id long, quality int, toxic int")
    rows = quality.digest(docs, labels).collect()
    assert len(rows) == len(messy) and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = quality.digest(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.digest(table([]), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_packed_rows_unpack_to_the_features():
    texts = [b"", b"one", " ".join(f"w{i % 70}" for i in range(500)).encode()]
    rows = quality.Packed([quality.pack(*np.unique(quality.ngrams(t, 18), return_counts=True)) for t in texts], [0, 1, 1])
    for text, (columns, values, _) in zip(texts, (rows[i] for i in range(3)), strict=True):
        want = quality.features(text, 18)
        assert (columns == want[0]).all() and (values == want[1]).all()


def test_training_equals_a_dense_loop():
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(60):
        columns = np.unique(rnd.integers(0, 32, 6))
        rows.append((columns, rnd.uniform(0, 4, len(columns)), int(columns[0] % 2)))
    got = quality.follow_leader(rows, 5, epochs=3)
    z, n, alpha, beta, l1, l2 = np.zeros(33), np.zeros(33), 0.5, 0.1, 0.02, 0.02
    order = np.random.default_rng(5)

    def weight(j):
        if abs(z[j]) <= l1:
            return 0.0
        return -(z[j] - np.sign(z[j]) * l1) / ((beta + n[j] ** 0.5) / alpha + l2)

    for _ in range(3):
        for i in order.permutation(60):
            x = np.zeros(33)
            x[rows[i][0]], x[32] = rows[i][1], 1
            w = [weight(j) for j in range(33)]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for j in np.flatnonzero(x):
                g = (p - rows[i][2]) * x[j]
                z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / alpha * w[j]
                n[j] += g * g
    assert np.allclose(got.weights, [weight(j) for j in range(32)], atol=1e-5) and abs(got.intercept - weight(32)) < 1e-9

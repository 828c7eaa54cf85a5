import math
import random

import numpy as np
import pytest

from isohyet.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, number string"


def brute(rows, every=100, k=5):
    keep = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for a in keep:
        if a[0] % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[2], r[2], strict=False)), r[0], r) for r in keep if r != a), key=lambda s: s[:2])
        for s, i, _ in [s for s in scored if s[2][1] == a[1]][:k]:
            near = [(-t, j) for t, j, r in scored if r[1] != a[1] and -80 * s <= -100 * t <= -100 * s][:k]
            out += [(a[0], i, n + 1, j, -s, t) for n, (t, j) in enumerate(near)]
    return sorted(out)


def vectors(n, seed, dim=12, ids=None):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    x = centres[rnd.integers(0, 6, n)] * rnd.uniform(0, 1.5, (n, 1)) + rnd.normal(size=(n, dim)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(c) for c in v], int(rnd.integers(0, 10))) for i, v in zip(ids or range(n), x, strict=True)]


def rows(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.fixture
def make(spark):
    return lambda data: spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA).repartition(3)


def test_equals_brute_force_with_odd_rows(make):
    data = vectors(900, 1)
    same = data[3][1]
    data += [(1000 + i, same, i % 3) for i in range(150)]  # ties
    data += [(None, same, 1), (2000, None, 1), (2100, same, None), (2200, [float("nan")] * 12, 1), (2300, [None] * 12, 2),
             (2400, [float("inf")] * 12, 1), (2500, [], 4), (2600, [0.0] * 12, 5), (2700, same[:5], 1), (2800, [30.0] * 12, 2),
             (-100, same, 3), (-7, same, 9)]
    data += data[:40] + [(0, data[5][1], 2)]  # repeated rows, and another row of an id
    got = rows(negatives.hard_negatives(make(data)))
    assert got == brute(data) and len(got) > 100


def test_many_cells_give_the_same(make, monkeypatch):
    monkeypatch.setattr(negatives, "MEMBERS", 5)
    data = vectors(1200, 2)
    got = rows(negatives.hard_negatives(make(data), every=10, per_cell=20, block=150, sample=60))
    assert got == brute(data, 10)


def test_large_components(make):
    rnd = random.Random(4)
    data = [(i, [rnd.uniform(-1, 1) * 2 ** 17 for _ in range(6)], i % 2) for i in range(300)]
    assert rows(negatives.hard_negatives(make(data), every=50)) == brute(data, 50)


def test_walks_stop_early_and_lose_nothing():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-200, 200, (4000, 8))
    x[:40] = x[0] + rnd.integers(-3, 3, (40, 8))
    anchor = x[:1]
    low, high = np.array([-(1 << 62)]), np.array([1 << 62])
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key)
            return super().__getitem__(key)

    w = negatives.Walkers(anchor, np.array([0]), np.array([0]), True, low, high, 5)
    cosine = (negatives.unit(x.astype(float)) @ negatives.unit(anchor.astype(float))[0])
    bound = np.linalg.norm(x, axis=1) * np.cos(np.arccos(np.clip(cosine, -1, 1)))
    order = np.argsort(-bound, kind="stable")
    w.walk(bound[order], order, np.zeros(len(x), int), x[order].view(Counted), np.where(order == 0, 0, -1))
    best = sorted((-int(s), i) for i, s in enumerate(x @ anchor[0]) if i)[:5]
    assert list(zip((-w.found[1]).tolist(), w.found[2].tolist(), strict=True)) == best
    assert len(seen) == 1


def test_empty_tables(make):
    assert rows(negatives.hard_negatives(make([]))) == []
    assert rows(negatives.hard_negatives(make([(1, [0.5], 1)]))) == []
    assert rows(negatives.hard_negatives(make([(100, [0.5], 1)]))) == []

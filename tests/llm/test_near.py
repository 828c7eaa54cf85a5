from itertools import combinations

import pytest

from isohyet.llm import near
from isohyet.llm.text import word_hashes


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            group[top(i)] = top(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((str(doc_id), len(sets[i]), str(min(ids) if ids else None)))
    return sorted(out)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_match_brute_force(table, messy, words, percent):
    got = near.near_groups(table(messy, extra=True), words, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(messy, words, percent)


def test_chain_and_star(table):
    base = [f"a{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for i in range(60):  # copies of one text that are not near each other
        own = list(base)
        for k in range(4):
            own[(i * 5 + k * 70) % 300] = f"s{i}x{k}"
        rows.append((100 + i, " ".join(own)))
    chain = [f"c{i}" for i in range(400)]
    for i in range(40):  # each near the one before only
        chain[i * 9: i * 9 + 9] = [f"n{i}x{k}" for k in range(9)]
        rows.append((900 - i, " ".join(chain)))
    got = near.near_groups(table(rows), 3, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, 85)


def test_one_of_each_group_stays(table, messy):
    docs = table(messy, extra=True)
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    left = brute(messy, 5, 80)
    assert {str(r.doc_id) for r in rows} == {c for _, _, c in left}
    assert sum(r.doc_id == 20 and r.text.startswith("dup") for r in rows) == 1


def test_empty_and_blank(table):
    assert near.digest(table([])).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.digest(table([(2, None), (1, ""), (3, " ")])).collect()}
    assert got == {i: (0, i, True) for i in (1, 2, 3)}


def test_components_of_random_graph(spark):
    import random

    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    label = {v: v for e in edges for v in e}
    for _ in range(200):
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    got = {r.c: r.label for r in near.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {v: c for v, c in label.items() if v in got}
    assert set(got) == {v for x, y in edges if x != y for v in (x, y)}


def test_bits_never_reject_a_pair_within_the_distance(spark):
    """Signatures that differ in up to 2 * CHUNKS - 1 places may differ in as many low bits."""
    rows = [(k, 100, (1 << k) - 1) for k in range(2 * near.CHUNKS + 1)]
    df = spark.createDataFrame(rows, "k long, n long, bits long")
    zero = df.filter("k = 0").alias("a")
    got = {r.k for r in zero.join(df.alias("b"), near._possible("a", "b", 80)).select("b.k").collect()}
    assert got == set(range(2 * near.CHUNKS))


def thue_morse(n):
    """Two different words of n letters that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [512, 4096])
def test_words_built_to_collide_differ(table, size):
    x, y = thue_morse(size)
    a, b = word_hashes([x.encode(), y.encode()])
    assert a[0] != b[0]
    got = {r.doc_id: r for r in near.digest(table([(1, f"one {x} two"), (2, f"one {y} two"), (3, f"one {x} two")])).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 2, 1]

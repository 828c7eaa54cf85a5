import random

from isohyet.llm import packing


def naive(lengths, capacities):
    """One chunk at a time, the open bin with the least room first; bins open in runs as the histogram opens them."""
    left = sorted(lengths, reverse=True)
    bins = []
    counts = {}
    for x in left:
        counts[x] = counts.get(x, 0) + 1
    done = {}
    for x in left:
        n = done.get(x, 0)
        fits = [b for b in bins if b[0] >= x]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            shorter = sorted(k for k in counts if k < x)
            b = [packing.opened(x, counts[x] - n, shorter, counts, capacities), 0]
            bins.append(b)
        b[0] -= x
        b[1] += x
        done[x] = n + 1
    return bins


def test_histogram_packs_as_one_by_one():
    rnd = random.Random(1)
    for capacities in ((50,), (20, 50), (16, 32, 64)):
        lengths = [rnd.randint(1, max(capacities)) for _ in range(400)]
        counts = {}
        for x in lengths:
            counts[x] = counts.get(x, 0) + 1
        got = packing.pack_lengths(counts, capacities)
        placed = {}
        for b in got:
            assert b.used == sum(n * k for n, _, k, _ in b.contents) <= max(capacities)
            for n, _, k, _ in b.contents:
                placed[n] = placed.get(n, 0) + k * b.count
        assert placed == counts
        one = naive(lengths, capacities)
        cost = lambda used: packing.fitting(capacities, used)
        assert sum(cost(b.used) * b.count for b in got) <= 1.03 * sum(cost(b[1]) for b in one)
        if len(capacities) == 1:
            assert sum(b.count for b in got) == len(one)


def test_every_word_is_placed_once(table, messy):
    caps = (16, 64, 256)
    rows = packing.best_fit(table(messy, extra=True), caps).collect()
    want = sorted(len((t or "").encode().split()) + 1 for _, t in messy)
    chunks = {}
    for r in rows:
        chunks.setdefault(r.bin_id, []).append(r)
    assert sum(r.length for r in rows) == sum(want)
    assert sorted(chunks) == list(range(len(chunks)))
    for own in chunks.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at
            at += r.length
        assert {(r.filled, r.capacity) for r in own} == {(at, packing.fitting(caps, at))}
    unique = [r for r in rows if r.doc_id == 16]
    assert sorted((r.chunk, r.first_word, r.length) for r in unique) == [
        (i, i * 256, min(256, 3001 - i * 256)) for i in range(12)]


def test_empty_table(table):
    assert packing.best_fit(table([])).count() == 0

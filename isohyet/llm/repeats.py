"""Windows of a sequence that start more than once in the whole collection, found exactly without a row per window.

Every window of ``window`` symbols has an anchor: the leftmost of its ``k``-symbol
strings with the smallest hash.  Equal windows have their anchor at the same place,
so windows can only be equal where anchors are.  Consecutive windows of a document
that share an anchor form a *path*; a path is one row: place, hash of the anchor
(``ak``) and hash of all its symbols (``path``).

* An anchor that occurs once: none of its windows is repeated.  Most rows end here.
* A path that occurs twice or more: all its windows are repeated.
* A path that occurs once, at an anchor with other paths: a *branch*.  There one copy of
  every path is opened up into its windows, which are counted one by one.

Counts are partial aggregates and joins, so that a passage with a third of all
occurrences splits like any other key.  Paths and windows are compared by hashes modulo
a prime whose base every run draws anew, so no text can be built to collide, and only below
one anchor hash: two different ones match with a chance of less than 2**-50, whatever the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from isohyet.llm.text import KEY, PrimeHash, SpanHash, checked, drawn_base, each_batch, mix, packed, raw_texts, same, unpack
from isohyet.session import cut_lineage

ANCHOR_BASE = 0x9E3779B97F4A7C15
#: Symbols handled at once; longer documents are cut into overlapping pieces.
CHUNK = 1 << 17
#: A place is one number: start of the path, then ten bits for the anchor's offset and ten for the windows after the first.
OFFSET, LENGTH = 1 << 10, 1 << 20
#: Rows of one path that a task joins, about; more are dealt to several tasks.
FREQUENT = 1 << 12


@dataclass(frozen=True)
class Spec:
    """What is compared: ``window`` symbols (1,000 at most), anchors of ``k`` symbols.

    ``symbols`` gives the 64-bit symbols of each of some texts (null: none), ``edges`` the
    first byte of every symbol of a text and the byte behind it.  ``group`` paths at most share
    a task's memory; anchors with more branches are settled by aggregates and joins.  ``base``
    is that of the hashes, one for all tasks of a run.
    """

    window: int
    k: int
    symbols: Callable[[list[bytes | None]], list[np.ndarray]]
    edges: Callable[[bytes], tuple[np.ndarray, np.ndarray]]
    group: int = 1500
    base: int = field(default_factory=drawn_base)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if have < width else x


def pieces(lengths: list[int], window: int, chunk: int = CHUNK) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, start, stop) of about ``chunk`` symbols; every window lies in one piece."""
    group, held = [], 0
    for i, n in enumerate(lengths):
        for start in range(0, n - window + 1, chunk):
            stop = min(n, start + chunk + window - 1)
            group.append((i, start, stop))
            held += stop - start
            if held >= chunk:
                yield group
                group, held = [], 0
    if group:
        yield group


def paths_of(symbols: np.ndarray, stops: np.ndarray, spec: Spec):
    """First window, windows after it, anchor, ``ak`` and ``path`` of the paths of joined pieces that end at ``stops``."""
    window, k = spec.window, spec.k
    anchors = SpanHash(symbols, ANCHOR_BASE).rolling(k)
    order = anchors & np.uint64(0xFFFFFFFF00000000)
    order |= np.arange(len(order), dtype=np.uint64)
    at = (sliding_min(order, window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(len(at), bool)
    for stop in stops[:-1]:
        valid[stop - window + 1: stop] = False
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[stops[:-1]] = True
    first = np.flatnonzero(new & valid)
    last = np.append(first[1:], len(at)) - 1
    ends = stops[np.searchsorted(stops, first, side="right")] - window
    last = np.minimum(last, ends)
    at = at[first]
    whole = PrimeHash(symbols, spec.base).of(first, last + window)
    return first, last - first, at, anchors[at], mix(whole + (at - first).astype(np.uint64))


def _int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def all_paths(docs: DataFrame, spec: Spec) -> DataFrame:
    """A row per path: key of the document, ``place``, ``ak``, ``path``."""

    def make():
        def step(batch):
            texts = spec.symbols(raw_texts(batch.column("text")))
            out = []
            for group in pieces([len(x) for x in texts], spec.window):
                joined = np.concatenate([texts[i][a:b] for i, a, b in group])
                sizes = np.array([b - a for _, a, b in group])
                stops = np.cumsum(sizes)
                first, more, at, ak, path = paths_of(joined, stops, spec)
                piece = np.searchsorted(stops, first, side="right")
                shift = np.array([a for _, a, _ in group]) - (stops - sizes)
                place = (first + shift[piece]) * LENGTH + (at - first) * OFFSET + more
                out.append((np.array([i for i, _, _ in group])[piece], place, _int64(ak), _int64(path)))
            if out:
                rows, place, ak, path = (np.concatenate(x) for x in zip(*out, strict=True))
                keys = [batch.column(c).take(pa.array(rows)) for c in KEY]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(place), pa.array(ak), pa.array(path)],
                                                 [*KEY, "place", "ak", "path"])

        return step

    return each_batch(docs.select(*KEY, "text"), make, "doc_id long, th long, place long, ak long, path long")


def windows_of(spec: Spec, ak: np.ndarray, first: np.ndarray, offset: np.ndarray, spans: list[bytes]):
    """Path (by index), start and identity of every window of some paths."""
    symbols = spec.symbols(spans)
    sizes = np.array([len(x) for x in symbols])
    hashes = PrimeHash(np.concatenate(symbols), spec.base).rolling(spec.window)
    counts = sizes - spec.window + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    here = hashes[at + (np.cumsum(sizes) - sizes)[row]]
    identity = mix(mix(ak.view(np.uint64)[row] + (offset[row] - at).astype(np.uint64)) ^ here)
    return row, first[row] + at, identity


def _open(joined: DataFrame, spec: Spec) -> DataFrame:
    """The bytes of every branch path, from the packed texts and the lists of places."""

    def make():
        def step(batch):
            lists = batch.column("places")
            items = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            place = items.field("place").to_numpy()
            first, offset, more = place // LENGTH, place % LENGTH // OFFSET, place % OFFSET
            texts = unpack(batch.column("packed"))
            spans, edges, known = [], None, -1
            for i, a, b in zip(owner, first, first + more + spec.window, strict=True):
                if i != known:
                    edges, known = spec.edges(texts[i]), i
                spans.append(texts[i][edges[0][a]: edges[1][b - 1]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(owner)) for c in KEY), *(items.field(c) for c in ("ak", "n", "paths")),
                 pa.array(first), pa.array(offset), pa.array(spans, pa.binary())],
                [*KEY, "ak", "n", "paths", "first", "offset", "span"])

        return step

    return each_batch(joined, make, "doc_id long, th long, ak long, n long, paths long, first long, offset long, span binary")


def _by_anchor(opened: DataFrame, spec: Spec) -> DataFrame:
    """Repeated windows of branches, whole anchors in a task: sorted by anchor and settled a few anchors at a time."""

    def settle(table: pa.Table):
        cols = {c: table.column(c).combine_chunks() for c in table.column_names}
        ak, n, first, offset = (cols[c].to_numpy() for c in ("ak", "n", "first", "offset"))
        row, start, identity = windows_of(spec, ak, first, offset, raw_texts(cols["span"]))
        _, inverse = np.unique(identity, return_inverse=True)
        found = (np.bincount(inverse, n[row])[inverse] >= 2) & (n[row] == 1)
        row, start = row[found], start[found]
        if len(row):
            new = np.r_[True, (np.diff(row) != 0) | (np.diff(start) != 1)]
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(row)] - 1
            keys = [cols[c].take(pa.array(row[head])) for c in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start[head]), pa.array(start[tail])], [*KEY, "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("span").nbytes
            if size < 1 << 21:
                continue
            table = pa.Table.from_batches(held)
            ak = table.column("ak").to_numpy()
            cut = int(np.searchsorted(ak, ak[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield from settle(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(x.column("span").nbytes for x in held)
        if held:
            yield from settle(pa.Table.from_batches(held))

    ordered = opened.repartition("ak").sortWithinPartitions("ak")
    return ordered.mapInArrow(run, "doc_id long, th long, lo long, hi long")


def _by_window(opened: DataFrame, spec: Spec) -> DataFrame:
    """The same for anchors with very many branches: a row per window, counted by aggregates and joins."""

    def make():
        def step(batch):
            ak, n, first, offset = (batch.column(c).to_numpy() for c in ("ak", "n", "first", "offset"))
            spans = raw_texts(batch.column("span"))
            for a in range(0, len(spans), 256):
                part = slice(a, a + 256)
                row, start, identity = windows_of(spec, ak[part], first[part], offset[part], spans[part])
                keys = [batch.column(c).take(pa.array(row + a)) for c in KEY]
                here = [batch.column("ak").take(pa.array(row + a)), pa.array(_int64(identity))]
                yield pa.RecordBatch.from_arrays([*keys, *here, pa.array(n[row + a]), pa.array(start)],
                                                 [*KEY, "ak", "identity", "n", "lo"])

        return step

    rows = each_batch(opened, make, "doc_id long, th long, ak long, identity long, n long, lo long")
    totals = rows.groupBy("ak", "identity").agg(F.sum("n").alias("total")).filter("total >= 2")
    often = cut_lineage(totals.select("ak", "identity"))
    return rows.filter("n = 1").join(often, ["ak", "identity"], "left_semi").select(*KEY, "lo", F.col("lo").alias("hi"))


def of_repeated(paths: DataFrame, repeated: DataFrame) -> DataFrame:
    """The ``paths`` in ``repeated`` (``ak, path, n``); the ``n`` rows of a frequent one are dealt out by their places."""
    parts = F.ceil(F.col("n") / FREQUENT)
    often = checked(cut_lineage(repeated.filter(F.col("n") > FREQUENT).select("ak", "path", parts.alias("parts"))))
    part = F.coalesce(F.pmod(F.xxhash64(*KEY, "place"), F.col("parts")), F.lit(0))
    dealt = paths.join(often, ["ak", "path"], "left").select(*paths.columns, part.alias("part"))
    names = repeated.select("ak", "path", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return dealt.join(names, ["ak", "path", "part"], "left_semi").select(*paths.columns)


def repeated_ranges(docs: DataFrame, spec: Spec) -> DataFrame:
    """``ranges`` (first and last start of repeated windows) of every document that has some; ``docs`` is ``keyed``."""
    paths = all_paths(docs, spec)
    # a table of its own, so that the join can split the partition of a frequent anchor
    again = cut_lineage(paths.groupBy("ak").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("ak"))
    paths = cut_lineage(paths.join(again, "ak", "left_semi"))
    distinct = cut_lineage(paths.groupBy("ak", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "place")).alias("source")))
    anchors = distinct.groupBy("ak").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("paths"))
    anchors = cut_lineage(anchors.filter("least = 1 AND paths >= 2").select("ak", "paths"))

    branches = distinct.join(anchors, "ak").select("source.*", "ak", "n", "paths")
    places = branches.groupBy(*KEY).agg(F.collect_list(F.struct("place", "ak", "n", "paths")).alias("places"))
    joined = packed(docs).alias("t").join(places.alias("p"), same("t", "p", KEY)).select("t.*", "p.places")
    opened = cut_lineage(_open(joined, spec))
    whole = of_repeated(paths, distinct.filter("n >= 2"))
    first, more = F.floor(F.col("place") / LENGTH), F.col("place") % OFFSET
    found = whole.select(*KEY, first.alias("lo"), (first + more).alias("hi"))
    found = found.unionByName(_by_anchor(opened.filter(F.col("paths") <= spec.group), spec))
    found = found.unionByName(_by_window(opened.filter(F.col("paths") > spec.group), spec))
    return found.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def covered(lists: pa.Array, sizes: list[int], window: int) -> list[np.ndarray]:
    """For each document whether each symbol lies in a repeated window; null lists cover nothing."""
    out = []
    for ranges, n in zip(lists, sizes, strict=True):
        marks = np.zeros(n + 1, np.int64)
        if ranges.is_valid:
            items = ranges.values
            np.add.at(marks, items.field("lo").to_numpy(), 1)
            np.add.at(marks, items.field("hi").to_numpy() + window, -1)
        out.append(np.cumsum(marks[:-1]) > 0)
    return out


def without_repeats(documents: DataFrame, spec: Spec, docs: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """``cut(text, covered)`` of every document, one row each; its values follow ``doc_id``."""
    texts = packed(docs).alias("t")
    joined = texts.join(documents.alias("r"), same("t", "r", KEY), "left").select("t.*", "r.ranges")
    kinds = to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def make():
        def step(batch):
            texts = [t or b"" for t in unpack(batch.column("packed"))]
            marks = covered(batch.column("ranges"), [len(spec.edges(t)[0]) for t in texts], spec.window)
            values = zip(*(cut(t, m) for t, m in zip(texts, marks, strict=True)), strict=True)
            columns = [pa.array(x, kind) for x, kind in zip(values, kinds.types[1:], strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=kinds)

        return step

    return each_batch(joined, make, f"doc_id long, {schema}")


def runs(mask: np.ndarray) -> list[dict]:
    """Maximal runs of true as ``start`` and ``stop``."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]

"""Best-fit packing (10): documents into sequences of several permitted lengths.

Lengths are words plus one end mark.  A document longer than the largest capacity is cut into chunks of
that capacity and a rest; nothing is truncated.  Chunks are placed longest first, each into the
open bin with the least room that holds it.  Where none does, a bin is opened whose capacity has the lowest
cost per word, judged by what can still fill it; at the end every bin shrinks to the smallest
permitted length that holds its contents.

Best fit only asks for lengths, so the whole corpus is packed on the histogram of lengths (at
most one row per word of the largest capacity): bins with equal contents are one row with a count.
Chunks then find their bins by their rank among chunks of equal length, which counts of hashed
cells provide without a global sort.

Null, empty and blank texts are one end mark long.  Rows that repeat are packed like others, ties
in id and text in any order.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.text import session_of
from isohyet.session import cut_lineage

CAPACITIES = (1024, 2048, 4096)
#: Cost of a sequence beside its length; rows of one cell at most, on average; largest plan to broadcast.
OVERHEAD, CELL_ROWS, BROADCAST_ROWS = 32, 5000, 200_000


@dataclass
class Bins:
    """``count`` bins with the same contents: (length, first rank, copies a bin, offset in the bin)."""

    count: int
    room: int
    used: int
    contents: list[tuple[int, int, int, int]]

    def split(self, n: int) -> Bins:
        """Take off the last ``count - n`` bins."""
        rest = Bins(self.count - n, self.room, self.used, [(a, r + n * k, k, o) for a, r, k, o in self.contents])
        self.count = n
        return rest

    def add(self, length: int, rank: int, copies: int) -> None:
        self.contents = [*self.contents, (length, rank, copies, self.used)]
        self.used += length * copies
        self.room -= length * copies


def fitting(capacities: tuple[int, ...], used: int) -> int:
    return next(c for c in sorted(capacities) if c >= used)


def opened(length: int, left: int, shorter: list[int], counts: dict[int, int], capacities: tuple[int, ...]) -> int:
    """Capacity of the lowest cost per word for a bin that starts with ``length``; ``shorter``: ascending lengths to come."""
    best = None
    for capacity in sorted(capacities, reverse=True):
        if capacity < length:
            continue
        copies = min(left, capacity // length)
        filled, top = copies * length, len(shorter)
        while top:
            top = bisect_right(shorter, capacity - filled, 0, top)
            if top:
                top -= 1
                filled += shorter[top] * min(counts[shorter[top]], (capacity - filled) // shorter[top])
        cost = (fitting(capacities, filled) + OVERHEAD) / filled
        if best is None or cost < best[0]:
            best = cost, capacity
    return best[1]


def pack_lengths(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> list[Bins]:
    """Best-fit decreasing over counts of lengths (1 to the largest capacity)."""
    lengths = sorted(histogram)
    rooms: list[int] = []  # ascending, of open bins
    by_room: dict[int, list[Bins]] = {}
    done: list[Bins] = []

    def keep(bins: Bins) -> None:
        if bins.room < lengths[0]:
            done.append(bins)
            return
        if bins.room not in by_room:
            by_room[bins.room] = []
            insort(rooms, bins.room)
        by_room[bins.room].append(bins)

    while lengths:
        length = lengths[-1]
        rank, left = 0, histogram[length]
        shorter = lengths[:-1]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                capacity = opened(length, left, shorter, histogram, capacities)
                bins = Bins(max(1, left // (capacity // length)), capacity, 0, [])
            copies = min(left, bins.room // length)
            full = min(bins.count, left // copies)
            if full < bins.count:
                keep(bins.split(full))
            bins.add(length, rank, copies)
            keep(bins)
            rank += full * copies
            left -= full * copies
        lengths = shorter
        if not lengths:
            break
    return done + [b for group in by_room.values() for b in group]


def plan_rows(bins: list[Bins], capacities: tuple[int, ...]) -> pa.Table:
    """(length, first, last, copies, offset, bin, capacity, used): ranks [first, last) of a length fill bins from ``bin`` on."""
    rows, at = [], 0
    for b in bins:
        capacity = fitting(capacities, b.used)
        rows += [(length, rank, rank + b.count * k, k, offset, at, capacity, b.used) for length, rank, k, offset in b.contents]
        at += b.count
    names = ["length", "first", "last", "copies", "start", "bin", "capacity", "used"]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def best_fit(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """A row per chunk: ``doc_id, chunk, first_word, length, bin_id, bin_offset, capacity, filled``."""
    spark = session_of(documents)
    largest = max(capacities)
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                            (words + 1).cast("long").alias("total"))
    chunks = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.floor((F.col("total") - 1) / largest)).cast("int"))))
    first = F.col("chunk").cast("long") * largest
    chunks = cut_lineage(chunks.select("doc_id", "th", "chunk", first.alias("first_word"),
                                       F.least(F.col("total") - first, F.lit(largest)).alias("length")))
    histogram = {r["length"]: r["n"] for r in chunks.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = max(1, sum(histogram.values()) // CELL_ROWS)
    table = plan_rows(pack_lengths(histogram, capacities), capacities)
    plan = spark.createDataFrame(table)
    if table.num_rows <= BROADCAST_ROWS:
        plan = F.broadcast(plan)

    rows = chunks.withColumn("cell", F.pmod(F.xxhash64("doc_id", "th", "chunk"), F.lit(cells)))
    counts = rows.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "th", "chunk")) - 1
    ranked = rows.withColumn("nth", nth).join(counts, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("nth"))
    on = (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    at = F.col("rank") - F.col("first")
    return ranked.alias("r").join(plan.alias("p"), on).select(
        "doc_id", "chunk", "first_word", F.col("r.length").alias("length"),
        (F.col("bin") + F.floor(at / F.col("copies"))).cast("long").alias("bin_id"),
        (F.col("start") + at % F.col("copies") * F.col("r.length")).alias("bin_offset"), "capacity", F.col("used").alias("filled"))


digest = best_fit

"""Sharding (3): a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

Every shard has ``nodes`` places on a ring of ``SLOTS`` slots; a document belongs to the first node clockwise
of the hash of its id (of its text, where the id is null).  A shard is full at its share of all rows:
without ``slack`` the counts of shards differ by one at most (law ``rows``), with slack a shard takes up to
``(1 + slack)`` times the mean.  First every arc fills the shard of its own node; the rows that
find it full go on clockwise, arc after arc, to the next node whose shard has room.  So only the
overflow moves.

The ring is finely cut into cells, more of them the more rows there are.  Counts of cells give every
row its rank in its arc (one shuffle of narrow rows by cell); the overflow is settled on the counts of
the ``shards * nodes`` arcs alone.

Null texts have size 1.  Rows that repeat get slots of their own, in the order of hash, id and
text; only rows that are equal in all these are interchangeable.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.text import session_of
from isohyet.session import cut_lineage

SLOT_BITS, POSITION_BITS, CELL_ROWS = 12, 62, 1000
SLOTS = 1 << SLOT_BITS


def ring(shards: int, nodes: int) -> list[int | None]:
    """Shard of the node in each slot; a taken slot passes a node on, so that more shards move no earlier node."""
    slots: list[int | None] = [None] * SLOTS
    for shard in range(shards):
        for node in range(nodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % SLOTS
            while slots[at] is not None:
                at = (at + 1) % SLOTS
            slots[at] = shard
    return slots


def arcs_of(slots: list[int | None]) -> tuple[list[int], list[int]]:
    """Shards of the nodes in ring order, and the node (by index) that each slot belongs to."""
    places = [i for i, s in enumerate(slots) if s is not None]
    owner, k = [], 0
    for i in range(len(slots)):
        while k < len(places) and places[k] < i:
            k += 1
        owner.append(k % len(places))
    return [slots[i] for i in places], owner


def settle(counts: list[int], nodes: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank behind the last, shard, first slot) for the rows of every arc."""
    room, used, out = list(room), [0] * len(room), []

    def put(arc: int, at: int, shard: int, n: int) -> None:
        if n:
            out.append((arc, at, at + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n

    left = []
    for arc, count in enumerate(counts):
        n = min(count, room[nodes[arc]])
        put(arc, 0, nodes[arc], n)
        left.append(n)
    for arc, count in enumerate(counts):
        at, k = left[arc], arc
        while at < count:
            k = (k + 1) % len(nodes)
            n = min(count - at, room[nodes[k]])
            put(arc, at, nodes[k], n)
            at += n
    return out


def ring_shards(documents: DataFrame, shards: int = 8, nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """A row per document: ``doc_id, size, text_crc32, shard, slot``."""
    spark = session_of(documents)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text))
    rows = cut_lineage(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"),
        F.xxhash64(key).bitwiseAND((1 << POSITION_BITS) - 1).alias("position")))
    total = rows.count()
    bits = min(30, max(SLOT_BITS, (total // CELL_ROWS).bit_length()))
    owners, arc_of = arcs_of(ring(shards, nodes))
    rows = rows.withColumn("cell", F.shiftright("position", POSITION_BITS - bits))
    lookup = F.lit(arc_of)
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("arc", lookup[F.shiftright("cell", bits - SLOT_BITS).cast("int")])
    # an arc that spans the seam of the ring has cells at both ends: any fixed order will do
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut_lineage(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    sums = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # shards * nodes rows
    share, extra = divmod(total, shards)
    room = [share + (s < extra) for s in range(shards)] if not slack else [int(-(-total * (1 + slack) // shards))] * shards
    parts = settle([sums.get(a, 0) for a in range(len(owners))], owners, room) or [(-1, 0, 0, 0, 0)]
    values = ", ".join(str(p) for p in parts)
    parts = spark.sql(f"SELECT * FROM VALUES {values} AS p(arc, first, last, shard, base)")

    ranked = rows.withColumn("nth", F.row_number().over(
        Window.partitionBy("cell").orderBy("position", "doc_id", "text_crc32", "size", "th")) - 1)
    ranked = ranked.join(cells.select("cell", "arc", "before"), "cell").withColumn("rank", F.col("before") + F.col("nth"))
    on = (F.col("r.arc") == F.col("p.arc")) & F.col("rank").between(F.col("first"), F.col("last") - 1)
    placed = ranked.alias("r").join(F.broadcast(parts).alias("p"), on)  # some rows for each of shards * nodes arcs
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                         (F.col("base") + F.col("rank") - F.col("first")).cast("long").alias("slot"))


def digest(documents: DataFrame) -> DataFrame:
    return ring_shards(documents).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Hard-negative mining (11): shared candidate lists of anchor clusters, walked until certified.

Anchors are clustered by direction.  For a cluster with centroid c and widest angle w, every candidate x has the bound
|x| cos(max(0, angle(x, c) - w)); times |a| it bounds the inner product with any member a.  Candidates are sorted
by it once, and every member walks that list until the bound falls below what it still needs: its k-th score so far, or
the least score it accepts.  The first walk finds the positives of every anchor, the second, for each anchor and
positive, the negatives from ``low`` percent of the positive's score up to all of it.

Work is cut into cells: at most about ``anchors`` anchors of near clusters with ``rows`` candidates.  A cell sorts and walks its own part of
the list and returns at most k rows for each anchor (and positive), which are merged by a window.  Centroids are
fitted on at most ``sample`` anchors; their number is bounded, so a large cluster is split over several cells.

Rows with a null id, label, vector or component, or a component that is not finite, take no part.  Rows alike in all
three columns count once; rows that share an id but differ are rows of their own, so that an id may have several
anchors' results.  A shorter vector counts as ending in zeros; ``floor(256 x)`` is held to at most 2**26 either way.  Empty tables give no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.text import session_of
from isohyet.session import cut_lineage

BOUND = 1 << 26
#: Members of a cluster for which another centroid is made, the most centroids, and candidates that a walk takes at a time.
MEMBERS, CENTROIDS, STRIDE = 256, 512, 512


def usable(embeddings: DataFrame, shift: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """``id, label, vec``: distinct rows that take part, with whole-number components; every ``shift``-th id has its label moved."""
    moved = F.when(F.col("id") % shift == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                             F.col("embedding").cast("array<double>").alias("x"))
    finite = "id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    whole = f"transform(x, c -> CAST(greatest(least(floor(c * {scale}D), {BOUND}), -{BOUND}) AS INT))"
    return rows.filter(finite).select("id", moved.alias("label"), F.expr(whole).alias("vec")).distinct()


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, ends filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(width, 1)), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def centroids_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions that group the sample (spherical k-means from evenly spaced rows)."""
    x = unit(sample.astype(float))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = np.linalg.norm(total, axis=1) > 0
        centres[full] = unit(total[full])
    return centres


class Walkers:
    """Anchors of one cluster, or anchor and positive pairs, that walk one list; each keeps its first ``k`` finds."""

    def __init__(self, vectors, owner, label, same: bool, low, high, k: int):
        self.vectors, self.owner, self.label, self.same, self.low, self.high, self.k = vectors, owner, label, same, low, high, k
        self.found = [np.zeros(0, np.int64)] * 4  # walker, score, id, row
        self.need = low.copy()  # scores below are of no use

    def walk(self, bound, ids, labels, vectors, own: np.ndarray) -> None:
        """Take candidates in the order of ``bound``, the greatest first; ``own[row]`` is the anchor that a row is, or -1."""
        norms = np.linalg.norm(self.vectors.astype(float), axis=1)[self.owner]
        exact = float if np.abs(self.vectors).max(initial=0) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 2 ** 52 else np.int64
        mine = self.vectors.astype(exact)
        for at in range(0, len(ids), STRIDE):
            # rounding: the bound is a float, the scores are whole numbers
            active = np.flatnonzero(norms * bound[at] * (1 + 1e-9) + 1e-3 >= self.need)
            if not len(active):
                return
            part = slice(at, at + STRIDE)
            anchors, row = np.unique(self.owner[active], return_inverse=True)
            scores = (mine[anchors] @ vectors[part].T.astype(exact)).astype(np.int64)[row]
            good = (scores >= self.need[active][:, None]) & (scores <= self.high[active][:, None])
            good &= (labels[part][None] == self.label[active][:, None]) == self.same
            good &= own[part][None] != self.owner[active][:, None]
            walker, place = np.nonzero(good)
            if len(walker):
                self.keep(active[walker], scores[walker, place], ids[part][place])

    def keep(self, walker, score, ids) -> None:
        walker, score, ids = (np.concatenate([a, b]) for a, b in zip(self.found, (walker, score, ids), strict=False))
        order = np.lexsort((ids, -score, walker))
        walker, score, ids = walker[order], score[order], ids[order]
        first = np.searchsorted(walker, walker)
        kept = np.arange(len(walker)) - first < self.k
        self.found = [walker[kept], score[kept], ids[kept]]
        full = np.arange(len(walker)) - first == self.k - 1  # an equal score with a smaller id may still come
        self.need[walker[full]] = np.maximum(self.need[walker[full]], score[full])


def cells(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and anchors, each once for every cell that it belongs to."""
    spread = F.xxhash64("id", "vec")
    candidates = rows.withColumn("block", F.pmod(spread, F.lit(blocks))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asking = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return candidates, asking


def searched(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, same: bool, k: int) -> DataFrame:
    """``anchor, asked, id, score``: the first ``k`` rows for every anchor row and thing asked.

    ``anchors`` has ``number, id, label, vec, cell, cluster, centre`` and ``asks``, an array of ``(asked, low, high)``.
    """

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("number", pa.int64()), ("asked", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = max(int(np.diff(t.column("vec").combine_chunks().offsets.to_numpy()).max()) for t in (left, right))
        x, a = matrix(right.column("vec"), width), matrix(left.column("vec"), width)
        ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
        number, a_ids, a_labels = (left.column(c).to_numpy() for c in ("number", "id", "label"))
        asks = left.column("asks").to_pylist()
        cluster = left.column("cluster").to_numpy()
        size, direction = np.linalg.norm(x.astype(float), axis=1), unit(x.astype(float))
        by_id: dict[int, list[int]] = {}
        for n, i in enumerate(a_ids.tolist()):
            by_id.setdefault(i, []).append(n)
        out = []
        for c in np.unique(cluster):
            members = np.flatnonzero(cluster == c)
            toward = unit(a[members].astype(float))
            centre = unit(toward.sum(0, keepdims=True))[0]
            wide = np.arccos(np.clip((toward @ centre).min(), -1, 1))
            apart = np.arccos(np.clip(direction @ centre, -1, 1))
            bound = size * np.cos(np.maximum(0, apart - wide))
            order = np.argsort(-bound, kind="stable")
            place = {int(m): n for n, m in enumerate(members)}
            own = np.full(len(ids), -1, np.int64)  # which member a candidate itself is
            for row in np.flatnonzero(np.isin(ids, a_ids[members])).tolist():
                for n in by_id[int(ids[row])]:
                    if n in place and labels[row] == a_labels[n] and np.array_equal(x[row], a[n]):
                        own[row] = place[n]
            wanted = [(place[int(m)], int(m), ask["asked"], ask["low"], ask["high"]) for m in members for ask in asks[m]]
            if not wanted:
                continue
            owner, anchor, asked, low, high = (np.array(w, np.int64) for w in zip(*wanted, strict=True))
            walkers = Walkers(a[members], owner, a_labels[anchor], same, low, high, k)
            walkers.walk(bound[order], ids[order], labels[order], x[order], own[order])
            walker, score, found = walkers.found[:3]
            out.append(pa.table([number[anchor[walker]], asked[walker], found, score], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    candidates, asking = cells(rows, anchors, groups, blocks)
    found = asking.groupBy("cell", "block").cogroup(candidates.groupBy("cell", "block")).applyInArrow(
        search, "number long, asked long, id long, score long")
    order = Window.partitionBy("number", "asked").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def placed(anchors: DataFrame, count: int, per_cell: int, sample: int) -> tuple[DataFrame, int]:
    """Anchors with their ``cluster`` and ``cell``, and the number of cells."""
    spark = anchors.sparkSession
    chosen = anchors.orderBy(F.xxhash64("id", "vec")).limit(sample).select("vec").toArrow().column("vec")
    width = max((len(v) for v in chosen.to_pylist()), default=0)
    k = min(CENTROIDS, max(1, -(-count // MEMBERS)))
    centres: Broadcast = spark.sparkContext.broadcast(centroids_of(matrix(chosen, width), k))

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            x = matrix(batch.column("vec"), max(width, int(sizes.max(initial=0))))[:, :max(width, 1)]
            near = (x.astype(float) @ centres.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], [*batch.schema.names, "cluster"])

    assigned = cut_lineage(anchors.mapInArrow(assign, "number long, id long, label long, vec array<int>, cluster long"))
    sizes = {r["cluster"]: r["count"] for r in assigned.groupBy("cluster").count().collect()}  # no more than CENTROIDS rows
    first, cells_, held = {}, 0, 0
    for c in sorted(sizes):  # small clusters share a cell, large ones have several
        if held and held + sizes[c] > per_cell:
            cells_, held = cells_ + 1, 0
        first[c] = (cells_, max(1, -(-sizes[c] // per_cell)))
        held += sizes[c]
        if first[c][1] > 1:
            cells_, held = cells_ + first[c][1], 0
    total = cells_ + (1 if held else 0)
    table = spark.createDataFrame([(c, *v) for c, v in first.items()], "cluster long, first int, parts int")
    cell = (F.col("first") + F.pmod(F.xxhash64("number"), F.col("parts"))).cast("int")
    return assigned.join(F.broadcast(table), "cluster").withColumn("cell", cell).drop("first", "parts"), max(1, total)


def hard_negatives(embeddings: DataFrame, every: int = 100, k: int = 5, low: int = 80, per_cell: int = 2048, block: int = 16_384,
                   sample: int = 20_000, shift: int = 7, labels: int = 10) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, see the head of this file.

    Anchors are the rows whose id is divisible by ``every``; ``k`` positives each and ``k`` negatives for each of these,
    scoring from ``low`` percent of the positive up to the positive.
    """
    session_of(embeddings)
    rows = cut_lineage(usable(embeddings, shift, labels))
    number = F.xxhash64("id", "label", "vec")  # names an anchor row; ids may repeat
    anchors = cut_lineage(rows.filter(F.col("id") % every == 0).select(number.alias("number"), "id", "label", "vec"))
    total, count = rows.count(), anchors.count()
    if not count:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    asking, groups = placed(anchors, count, per_cell, sample)
    asking = cut_lineage(asking)
    blocks = max(1, -(-total // block))
    anything = F.expr(f"array(named_struct('asked', 0L, 'low', {-(1 << 62)}L, 'high', {1 << 62}L))")
    positives = cut_lineage(searched(rows, asking.withColumn("asks", anything), groups, blocks, True, k))
    least = F.expr(f"CAST(ceil({low} * score / CAST(100 AS DECIMAL(3, 0))) AS LONG)")
    wanted = positives.withColumn("least", least).groupBy("number").agg(F.collect_list(F.struct(
        F.col("rank").cast("long").alias("asked"), F.col("least").alias("low"), F.col("score").alias("high"))).alias("asks"))
    found = searched(rows, asking.join(wanted, "number"), groups, blocks, False, k)
    named = found.join(asking.select("number", F.col("id").alias("anchor_id")), "number")
    chosen = positives.select("number", F.col("rank").cast("long").alias("asked"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(chosen, ["number", "asked"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

"""Elevation tiles and distance lattices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.schemas import RASTER_NODATA
from isohyet.session import cut_lineage

PIXELS = "tile string, row int, col int, elev int"


def _decode(files: Iterator[pd.DataFrame], nodata: int) -> Iterator[pd.DataFrame]:
    """Square big-endian int16 tiles to pixel rows, a band of raster rows at a time."""
    for batch in files:
        for path, content in zip(batch["path"], batch["content"]):
            data = np.frombuffer(content, dtype=">i2").astype("int32")
            size = round(len(data) ** 0.5)
            if size * size != len(data):
                raise ValueError(f"{path}: not a square int16 raster")
            name = path.rsplit("/", 1)[-1]
            band = max(1, 200_000 // size)
            for top in range(0, size, band):
                part = data[top * size:(top + band) * size]
                at = np.arange(top * size, top * size + len(part))
                elev = pd.Series(part, dtype="Int32").mask(part == nodata)
                yield pd.DataFrame({"tile": name, "row": (at // size).astype("int32"),
                                    "col": (at % size).astype("int32"), "elev": elev})


def read_elevation(spark: SparkSession, path: str, nodata: int = RASTER_NODATA) -> DataFrame:
    """All tiles below ``path`` as (tile, row, col, elev), no data as null.

    A tile is one task's unit; the format fixes its size (26 MB at most).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").option(
        "recursiveFileLookup", True
    ).load(path)
    return decode_tiles(files, nodata)


def decode_tiles(files: DataFrame, nodata: int = RASTER_NODATA) -> DataFrame:
    """Pixels of tiles given as rows (path, content)."""
    return files.select("path", "content").mapInPandas(lambda it: _decode(it, nodata), PIXELS)


def tile_files(pixels: DataFrame, size: int, nodata: int = RASTER_NODATA) -> DataFrame:
    """Tiles as rows (path, content) in the format that ``decode_tiles`` reads; absent pixels are without data."""
    whole = pixels.select("tile").distinct().selectExpr("tile", f"explode(sequence(0, {size - 1})) AS row").selectExpr(
        "tile", "row", f"explode(sequence(0, {size - 1})) AS col")
    digits = f"lpad(hex(CAST(coalesce(elev, {nodata}) & 65535 AS BIGINT)), 4, '0')"
    lines = whole.join(pixels.selectExpr("tile", "CAST(row AS INT) AS row", "CAST(col AS INT) AS col", "CAST(elev AS INT) AS elev"),
                       ["tile", "row", "col"], "left").groupBy("tile", "row").agg(
        F.expr(f"array_join(sort_array(collect_list(struct(col, {digits} AS x))).x, '') AS line"))
    return lines.groupBy("tile").agg(F.expr("unhex(array_join(sort_array(collect_list(struct(row, line))).line, '')) AS content")).select(
        F.col("tile").alias("path"), "content")


def read_lattice(spark: SparkSession, path: str) -> DataFrame:
    """Regular distance lattice kept as Parquet: lat_idx, lon_idx, lat, lon, dist."""
    return spark.read.schema("lat_idx bigint, lon_idx bigint, lat double, lon double, dist double").parquet(path)


#: Values of an axis in a block, blocks that are broadcast (4 MB of values and indexes at most), and values in a part of a block, which is one row.
AXIS_BLOCK, AXIS_ROWS, AXIS_PART = 4096, 64, 64


def values_up_to(values: Column, x: Column, bits: int) -> Column:
    """How many of the ordered values, fewer than 2**bits, are not above ``x``: a binary search over powers of two."""
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(values, at + s - 1) <= x, at + s).otherwise(at))


class Axis:
    """The distinct values of a lattice axis in order, in blocks of about ``AXIS_BLOCK`` that are cut in parts of ``AXIS_PART``, each with the
    value that follows it.  A row that is placed meets the first values of the blocks, then those of one block's parts, then one part: it
    never carries a whole block."""

    def __init__(self, grid: DataFrame, c: str, index: str | None = None):
        least = F.min(index) if index else F.lit(None)
        values = cut_lineage(grid.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(least.alias("i")))
        blocks = max(1, -(-values.count() // AXIS_BLOCK))
        placed = values.withColumn("block", F.lit(0)) if blocks == 1 else values.repartitionByRange(blocks, "v").withColumn(
            "block", F.spark_partition_id())
        placed = cut_lineage(placed)
        at = Window.orderBy("block")  # a row a block
        heads = placed.groupBy("block").agg(F.min(F.struct("v", "i")).alias("first"), F.count(F.lit(1)).alias("n"))
        heads = cut_lineage(heads.select("block", "first", "n", F.lead("first").over(at).alias("next"), (F.sum("n").over(at) - F.col("n")).alias("before")))
        inside = F.row_number().over(Window.partitionBy("block").orderBy("v")) - 1  # a block's values
        parts = placed.withColumn("part", F.floor(inside / AXIS_PART).cast("int")).groupBy("block", "part").agg(
            F.sort_array(F.collect_list(F.struct("v", "i"))).alias("o"))
        after = F.coalesce(F.lead(F.get("o", F.lit(0))).over(Window.partitionBy("block").orderBy("part")), F.col("next"))
        parts = cut_lineage(parts.join(heads.select("block", "next", "before"), "block").select(
            "block", "part", F.col("o.v").alias("v"), F.col("o.i").alias("i"), after.alias("next"), (F.col("before") + F.col("part") * AXIS_PART).alias("before")))
        firsts = cut_lineage(parts.groupBy("block").agg(F.sort_array(F.collect_list(F.get("v", F.lit(0)))).alias("firsts")))
        found = heads.agg(F.count(F.lit(1)), F.max("n")).first()
        self.parts, self.firsts = (F.broadcast(t) if found[0] <= AXIS_ROWS else t for t in (parts, firsts))
        self.block_bits, self.part_bits = found[0].bit_length(), (-(-(found[1] or 0) // AXIS_PART)).bit_length()
        self.heads = heads.agg(F.sort_array(F.collect_list(F.struct("first.v", "block"))).alias("o")).select(F.struct(F.col("o.v").alias("v"), F.col("o.block").alias("block"))).scalar()

    def attach(self, df: DataFrame, c: str) -> DataFrame:
        """``df`` with the part of a block that its column ``c`` falls in as struct ``_axis`` (ordered values ``v``, their indexes ``i``, ``next``, ``before``)
        and ``_below``, how many of its values are not above it.  Rows with a null value get nulls."""
        df = df.withColumn("_heads", self.heads)  # the first value of every block
        at = F.greatest(F.lit(0), values_up_to(F.col("_heads.v"), F.col(c), self.block_bits) - 1)
        placed = df.withColumn("_block", F.when(F.col(c).isNotNull(), F.get("_heads.block", at))).drop("_heads")
        placed = placed.join(self.firsts.withColumnRenamed("block", "_block"), "_block", "left")
        at = F.greatest(F.lit(0), values_up_to(F.col("firsts"), F.col(c), self.part_bits) - 1)
        placed = placed.withColumn("_part", F.when(F.col("_block").isNotNull(), at)).drop("firsts")
        axis = self.parts.select(F.col("block").alias("_block"), F.col("part").alias("_part"), F.struct("v", "i", "next", "before").alias("_axis"))
        placed = placed.join(axis, ["_block", "_part"], "left").drop("_block", "_part")
        return placed.withColumn("_below", values_up_to(F.col("_axis.v"), F.col(c), AXIS_PART.bit_length()))


def lattice_table(grid: DataFrame) -> DataFrame:
    """Lattice in long form from (lat, lon, dist) rows: adds the index on both axes.

    The index is the position among the axis' distinct values, which may have uneven steps; no global sort is needed.
    """
    placed = grid
    for c in ("lat", "lon"):
        placed = Axis(grid, c).attach(placed, c)
        index = F.greatest(F.lit(0), F.col("_below") - 1).cast("long") + F.col("_axis.before")
        placed = placed.withColumn(f"{c}_idx", index).drop("_axis", "_below")
    return placed

"""Rasters and lattices as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.geo import tile_name
from isohyet.schemas import RASTER_RADII
from isohyet.session import cut_lineage
from isohyet.sources.rasters import Axis


def focal_stats(pixels: DataFrame, radii: dict[str, int] = RASTER_RADII) -> DataFrame:
    """Elevation, topographic position and roughness of every pixel that has data.

    ``pixels`` has tile, row, col, elev (integer, null for no data).  The
    neighbourhood is the square of the given radius, clipped at the tile's
    edge; position is elev - mean and roughness the population deviation.

    A square sum is a sum along the row, then along the column.  Both are
    differences of two running sums, so the cost per pixel does not depend on
    the radius, and a task holds one row or column of a tile at a time.
    All sums are integers, hence exact.
    """
    base = pixels.select("tile", "row", "col", "elev", F.col("elev").isNotNull().cast("long").alias("_n"),
                         F.coalesce(F.col("elev").cast("long"), F.lit(0)).alias("_s"))
    base = base.withColumn("_q", F.col("_s") * F.col("_s"))

    def box(df, group, order, names, radius_of):
        w = Window.partitionBy("tile", group).orderBy(order)

        def running(c, end):
            return F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, end))

        return df.select("*", *[
            (running(c, radius_of[new]) - F.coalesce(running(c, -radius_of[new] - 1), F.lit(0))).alias(new)
            for c, new in names
        ])

    across = [(f"_{k}", f"_{k}_{r}") for r in radii for k in "nsq"]
    df = box(base, "row", "col", across, {f"_{k}_{r}": radii[r] for r in radii for k in "nsq"})
    down = [(f"_{k}_{r}", f"{k}_{r}") for r in radii for k in "nsq"]
    df = box(df, "col", "row", down, {f"{k}_{r}": radii[r] for r in radii for k in "nsq"})
    out = df.filter("elev IS NOT NULL")
    for r in radii:
        n, s, q = (F.col(f"{k}_{r}") for k in "nsq")
        out = out.withColumns({
            f"tpi_{r}": F.col("elev").cast("double") - s.cast("double") / n,
            f"roughness_{r}": F.sqrt((n * q - s * s).cast("double")) / n,
        })
    stats = [f"{m}_{r}" for r in radii for m in ("tpi", "roughness")]
    return out.select("tile", "row", "col", F.col("elev").cast("double").alias("elevation"), *stats)


def pixel_of(points: DataFrame, size: int) -> DataFrame:
    """Add tile name, row and column of points in one-degree tiles of size x size pixels.

    Pixels are centred on the sample points; row 0 is the north edge.
    """
    north = F.floor("lat") + 1
    return points.withColumns({
        "tile": tile_name(F.col("lat"), F.col("lon")),
        "row": F.floor((north - F.col("lat")) * (size - 1) + 0.5).cast("int"),
        "col": F.floor((F.col("lon") - F.floor("lon")) * (size - 1) + 0.5).cast("int"),
    })


def terrain_stats(points: DataFrame, pixels: DataFrame, radii: dict[str, int] = RASTER_RADII) -> DataFrame:
    """Terrain of points with (tile, row, col); null where the tile or pixel has no data.

    Tiles without points are not computed.
    """
    wanted = pixels.join(points.select("tile").distinct(), "tile", "left_semi")
    return points.join(focal_stats(wanted, radii), ["tile", "row", "col"], "left")


SUMS = "tile string, row bigint, seg bigint, n array<bigint>, s array<bigint>, q array<bigint>, part string"
SEGMENT, BAND = 64, 64
_PART = f"concat(tile, '/', CAST(floor(row / {BAND}) AS STRING))"


def store_sums(pixels: DataFrame, path: str) -> None:
    """Write the summed-area table of ``pixels``: counts, sums and squares of all pixels up to a row and column; and the last row and
    column of every tile.

    A row of the table is ``SEGMENT`` columns of one raster row, in one folder for ``BAND`` raster rows of a tile, so that a look-up reads
    the bands of its corners and nothing else of a tile.  Missing pixels count as without data.  It is computed once, by
    running sums along rows and then columns; a task holds one row or column of a tile at a time.
    """
    pixels = pixels.select(F.col("tile").cast("string").alias("tile"), F.col("row").cast("long").alias("row"),
                           F.col("col").cast("long").alias("col"), F.col("elev").cast("long").alias("elev"))
    sides = cut_lineage(pixels.groupBy("tile").agg(F.max("row").alias("rows"), F.max("col").alias("cols")))
    sides.write.mode("overwrite").parquet(f"{path}/sides")
    whole = sides.selectExpr(
        "tile", "cols", "explode(sequence(0L, rows)) AS row").selectExpr("tile", "row", "explode(sequence(0L, cols)) AS col")
    base = whole.join(pixels, ["tile", "row", "col"], "left").selectExpr(
        "tile", "row", "col", "CAST(elev IS NOT NULL AS BIGINT) AS n", "coalesce(elev, 0L) AS s", "coalesce(elev * elev, 0L) AS q")

    def running(df, group, order):
        w = Window.partitionBy("tile", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("tile", "row", "col", *[F.sum(c).over(w).alias(c) for c in "nsq"])

    sums = running(running(base, "row", "col"), "col", "row")
    strips = sums.withColumn("seg", F.floor(F.col("col") / SEGMENT)).groupBy("tile", "row", "seg").agg(
        F.sort_array(F.collect_list(F.struct("col", "n", "s", "q"))).alias("v"))
    strips.select("tile", "row", "seg", *[F.col(f"v.{c}").alias(c) for c in "nsq"], F.expr(_PART).alias("part")).repartition("part").sortWithinPartitions(
        "part", "row", "seg").write.mode("overwrite").partitionBy("part").parquet(f"{path}/strips")


def _corners(points: DataFrame, sides: DataFrame, radii: dict[str, int]) -> DataFrame:
    """The four corners of every square around every point: box, sign, row, col; corners before row or column 0 are left out."""
    def corner(name, r, down, right):
        row = f"least(row + {r}, rows)" if down else f"row - {r} - 1"
        col = f"least(col + {r}, cols)" if right else f"col - {r} - 1"
        return f"struct('{name}' AS box, {1 if down == right else -1}L AS sign, {row} AS at_row, {col} AS at_col)"

    each = ", ".join(corner(name, r, down, right) for name, r in {"elevation": 0, **radii}.items() for down in (True, False) for right in (True, False))
    inside = points.join(sides, "tile").filter("row BETWEEN 0 AND rows AND col BETWEEN 0 AND cols")
    return inside.selectExpr("tile", "row AS p_row", "col AS p_col", f"inline(array({each}))").filter(
        "at_row >= 0 AND at_col >= 0").withColumnsRenamed({"at_row": "row", "at_col": "col"})


MOST_PARTS = 20_000


def terrain_by_sums(points: DataFrame, path: str, radii: dict[str, int] = RASTER_RADII) -> DataFrame:
    """``terrain_stats`` of points with (tile, row, col), from the table that ``store_sums`` wrote below ``path``.

    Every square is four look-ups by equi-join, whatever its radius; the elevation is the square of radius 0.  The folders that the
    corners lie in are named to the scan, up to ``MOST_PARTS`` of them; of more, whole tiles are scanned.
    """
    spark = points.sparkSession
    sums = spark.read.schema(SUMS).parquet(f"{path}/strips")
    sides = spark.read.schema("tile string, rows bigint, cols bigint").parquet(f"{path}/sides")
    tiles = points.select(F.col("tile").cast("string").alias("tile"), F.col("row").cast("long").alias("row"),
                          F.col("col").cast("long").alias("col")).distinct()
    corners = cut_lineage(_corners(tiles, sides, radii).withColumn("seg", F.floor(F.col("col") / SEGMENT)))
    parts = corners.selectExpr(f"{_PART} AS part").distinct().limit(MOST_PARTS + 1).collect()
    near = sums.filter(F.col("part").isin([r.part for r in parts])) if len(parts) <= MOST_PARTS else sums
    found = corners.join(near.drop("part"), ["tile", "row", "seg"]).selectExpr(
        "tile", "p_row AS row", "p_col AS col", "box", *[f"sign * get({c}, CAST(col % {SEGMENT} AS INT)) AS {c}" for c in "nsq"])
    boxes = found.groupBy("tile", "row", "col").agg(*[
        F.sum(F.when(F.col("box") == b, F.col(c))).alias(f"{c}_{b}") for b in ("elevation", *radii) for c in "nsq"]).filter("n_elevation > 0")
    out = boxes.withColumn("elevation", F.col("s_elevation").cast("double"))
    for r in radii:
        n, s, q = (F.col(f"{c}_{r}") for c in "nsq")
        out = out.withColumns({f"tpi_{r}": F.col("elevation") - s.cast("double") / n,
                               f"roughness_{r}": F.sqrt((n * q - s * s).cast("double")) / n})
    stats = ["elevation", *[f"{m}_{r}" for r in radii for m in ("tpi", "roughness")]]
    same = F.expr("CAST(p.tile AS STRING) = t.tile AND p.row = t.row AND p.col = t.col")
    return points.alias("p").join(out.select("tile", "row", "col", *stats).alias("t"), same, "left").select("p.*", *[f"t.{c}" for c in stats])


def nearest_lattice(points: DataFrame, lattice: DataFrame, value: str = "dist") -> DataFrame:
    """Value of the lattice point nearest on each axis by itself; steps may be uneven, the lower index counts on a tie.

    ``lattice`` has lat_idx, lon_idx, lat, lon and the value.  A point meets one part of a block of an axis' values and is searched
    within it; the nearest is the last value up to the point or the next.  The look-up is an equi-join, so no point meets more
    than one lattice row.
    """
    placed = points
    for c in ("lat", "lon"):
        placed = Axis(lattice, c, f"{c}_idx").attach(placed, c)
        def at(n):
            return F.when(F.get("_axis.v", n).isNotNull(), F.struct(F.get("_axis.v", n).alias("v"), F.get("_axis.i", n).alias("i")))

        near, far = at(F.col("_below") - 1), F.coalesce(at(F.col("_below")), F.col("_axis.next"))
        near, far = (F.when(x.isNotNull(), F.struct(F.abs(x["v"] - F.col(c)).alias("d"), x["i"].alias("i"))) for x in (near, far))
        placed = placed.withColumn(f"{c}_idx", F.least(near, far)["i"]).drop("_axis", "_below")
    return placed.join(lattice.select("lat_idx", "lon_idx", value), ["lat_idx", "lon_idx"], "left")

"""Neighbour series, static attributes and distance-weighted estimates on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.calendar import cyclic_time, index_hour
from isohyet.functions.geo import bearing
from isohyet.functions.weather import clamp_estimate
from isohyet.operators.neighbors import available_cells
from isohyet.schemas import DRIZZLE_CUTOFF, MEASURES, STATIC, TERRAIN
from isohyet.session import cut_lineage

TRIO = [f"neighbor_{i}_id" for i in (1, 2, 3)]
DISTANCES = [f"neighbor_{i}_distance" for i in (1, 2, 3)]
CELLS_PER_GROUP, HOURS_PER_BLOCK = 250, 720


def _code(cells: DataFrame) -> str:
    """SQL of a number that is near for cells that are near: the bits of latitude and longitude in turns.  Without places, one of the trio."""
    if not {"lat", "lon"} <= set(cells.columns):
        return f"xxhash64({', '.join(TRIO)})"

    def bits(c, low, high):  # 30 bits, each followed by an empty one
        out = f"CAST(floor(least(greatest((CAST({c} AS DOUBLE) - ({low})) / {high - low}D, 0D), 1D) * {2**30 - 1}D) AS BIGINT)"
        for n, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            out = f"transform(array({out}), x -> (x | shiftleft(x, {n})) & {mask}L)[0]"
        return out

    return f"{bits('lat', -90, 90)} + 2 * {bits('lon', -180, 180)}"


def grouped(cells: DataFrame, most: int = CELLS_PER_GROUP) -> DataFrame:
    """``cells`` with three neighbours, stored, in groups (``_group``) of about ``most`` that lie together.

    Groups are ranges of a curve through the plane, so they follow the density of the cells; where they lie decides
    only how many groups a station goes to and not the result.
    """
    spark = cells.sparkSession
    stored = cut_lineage(cells.dropna(subset=TRIO).selectExpr("*", f"{_code(cells)} AS _code"))
    n = stored.count()
    groups = max(1, -(-n // most), min(n, 2 * spark.sparkContext.defaultParallelism))
    placed = stored.repartitionByRange(groups, "_code", F.xxhash64("cell_id")) if groups > 1 else stored.coalesce(1)
    return cut_lineage(placed.withColumn("_group", F.spark_partition_id()).drop("_code"))


def cell_series(cells: DataFrame, hourly: DataFrame, measures: list[str] = MEASURES,
                cells_per_salt: int = CELLS_PER_GROUP, own: bool = False) -> DataFrame:
    """One row per cell and hour with the cell's columns and the three neighbour series.

    Equals the full outer join of the three series on the hour.  Cells that lie together share stations.  So the cells
    are dealt to groups of about ``cells_per_salt``, and a station's series goes once to every group that needs it,
    where the hour's values of all its stations are one map.  A cell looks up its three in the last join: neither the
    rows of a trio nor those of a cell are shuffled, and at most ``cells_per_salt`` times ``HOURS_PER_BLOCK`` rows come
    from one key, a group and block of hours.  With ``own`` cells are stations, and their own values follow as measure_own.
    """
    spark, near = cells.sparkSession, grouped(cells, cells_per_salt)
    sides = {f"n{i}": c for i, c in enumerate(TRIO, 1)} | ({"own": "cell_id"} if own else {})
    block = F.floor(F.col("h") / HOURS_PER_BLOCK).cast("int")
    ends = hourly.agg(F.struct(F.min(block).alias("a"), F.max(block).alias("b"))).scalar()
    members = near.select("_group", F.explode(F.array(*sides.values())).alias("station_id")).distinct()
    rows = hourly.select("station_id", "h", *measures).filter("h IS NOT NULL").join(members, "station_id").withColumn("_block", block)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "_group", "_block")
    one = rows.groupBy("_group", "_block", "h", "station_id").agg(*[F.max(c).alias(c) for c in measures])
    entry = F.struct("station_id", F.struct(*measures))
    maps = one.groupBy("_group", "_block", "h").agg(F.map_from_entries(F.collect_list(entry)).alias("_values"))
    rest = [c for c in cells.columns if c not in TRIO]
    near = near.withColumn("_blocks", F.sequence(ends["a"], ends["b"])).withColumn("_block", F.explode("_blocks"))
    found = maps.join(near, ["_group", "_block"]).select(*TRIO, *rest, "h", *[
        F.element_at("_values", F.col(c)).alias(f"_{side}") for side, c in sides.items()])
    found = found.filter(" OR ".join(f"_n{i} IS NOT NULL" for i in (1, 2, 3)))
    return found.select(*TRIO, *rest, "h", *[F.col(f"_{side}.{c}").alias(f"{c}_{side}") for side in sides for c in measures])


def weight_sql(distance: str) -> str:
    """SQL of the weight 1/d.

    At distance 0 it is a power of two so large that the station's own value
    comes out exactly, whatever the others say; if it has none, they decide.
    """
    return f"CASE WHEN {distance} = 0 THEN {2.0**200}D ELSE 1 / {distance} END"


def idw_sql(values: list[str], weights: list[str]) -> str:
    """SQL of Σ(v·w) / Σw over the values present; null where none is."""
    pairs = list(zip(values, weights))
    total = " + ".join(f"nvl({v} * {w}, 0D)" for v, w in pairs)
    weight = " + ".join(f"if(isnull({v}), 0D, {w})" for v, w in pairs)
    return f"try_divide({total}, {weight})"


WEIGHTS = ["w1", "w2", "w3"]


def with_weights(cells: DataFrame) -> DataFrame:
    """Cells with the weights of their neighbours instead of the distances."""
    return cells.selectExpr(*[c for c in cells.columns if c not in DISTANCES],
                            *[f"{weight_sql(d)} AS {w}" for d, w in zip(DISTANCES, WEIGHTS)])


def idw(series: DataFrame, measures: list[str] = MEASURES, cutoff: float | None = DRIZZLE_CUTOFF,
        clamped: bool = True, keep: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Distance-weighted estimates from ``cell_series`` rows of cells ``with_weights``."""
    raw = series.selectExpr(*keep, "h", *[
        f"{idw_sql([f'{c}_n{i}' for i in (1, 2, 3)], WEIGHTS)} AS {c}" for c in measures
    ])
    if not clamped:
        return raw
    return raw.select(*keep, "h", *[clamp_estimate(c, c, cutoff).alias(c) for c in measures])


def idw_grid(cells: DataFrame, hourly: DataFrame, measures: list[str] = MEASURES,
             cutoff: float | None = DRIZZLE_CUTOFF, checked: bool = True) -> DataFrame:
    """Interpolated series of every cell whose three neighbours have data: cell_id, h, hour, measures.

    ``checked`` is false where the caller knows that they have, at other hours perhaps.
    """
    place = [c for c in ("lat", "lon") if c in cells.columns]
    usable = (available_cells(cells, hourly) if checked else cells).select("cell_id", *place, *TRIO, *DISTANCES)
    out = idw(cell_series(with_weights(usable), hourly, measures), measures, cutoff)
    return out.withColumn("hour", index_hour("h"))


def static_features(cells: DataFrame, stations: DataFrame, terrain: bool = True, relative: bool = False) -> DataFrame:
    """Cells with target and neighbour attributes under their model names.

    Adds elevation, coast distance and (optionally) the four terrain values for
    the target and each neighbour, and dist_n1.._n3.  ``relative`` also adds
    the elevation difference and bearing from neighbour to target.
    """
    names = [*STATIC, *(TERRAIN if terrain else [])]
    out = cells.selectExpr(
        *[f"{c} AS {c}_target" if c in names else c for c in cells.columns if c in names or c not in TERRAIN],
        *[f"neighbor_{i}_distance AS dist_n{i}" for i in (1, 2, 3)],
    )
    place = ["latitude", "longitude"] if relative else []
    for i in (1, 2, 3):
        side = stations.selectExpr(f"station_id AS neighbor_{i}_id", *[f"{c} AS {c}_n{i}" for c in [*names, *place]])
        out = out.join(side, f"neighbor_{i}_id")
        if relative:
            out = out.withColumns({
                f"elevation_diff_n{i}": F.expr(f"elevation_n{i} - elevation_target"),
                f"bearing_n{i}": bearing(f"latitude_n{i}", f"longitude_n{i}", "lat", "lon"),
            }).drop(f"latitude_n{i}", f"longitude_n{i}")
    return out


def interpolation_features(cells: DataFrame, hourly: DataFrame, stations: DataFrame,
                           terrain: bool = True, checked: bool = True, own: bool = False) -> DataFrame:
    """Feature matrix of the learned interpolation, one row per cell and hour.

    24 neighbour values, statics of target and neighbours, and cyclic time.
    ``cells`` may also be stations as targets (then with cell_id = station_id); with ``own`` their
    own values are added as measure_own, from which ``training_rows`` takes the label.
    """
    wide = static_features(available_cells(cells, hourly) if checked else cells, stations, terrain)
    series = cell_series(wide, hourly, own=own).withColumn("hour", index_hour("h"))
    return cyclic_time(series, "hour").drop("is_boundary", *DISTANCES)


def training_rows(features: DataFrame, hourly: DataFrame, measure: str) -> DataFrame:
    """Features of station targets with the observed value, complete neighbour values only.

    Features that bring the targets' own values along (``interpolation_features`` with ``own``, from the same ``hourly``) are not joined with it again.
    """
    if f"{measure}_own" in features.columns:
        rows = features.withColumn("label", F.col(f"{measure}_own")).drop(*[f"{c}_own" for c in MEASURES])
    else:
        truth = hourly.select(F.col("station_id").alias("cell_id"), "h", F.col(measure).alias("label"))
        rows = features.join(truth, ["cell_id", "h"])
    return rows.dropna(subset=["label", *[f"{measure}_n{i}" for i in (1, 2, 3)]])

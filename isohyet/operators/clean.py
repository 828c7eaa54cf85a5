"""From raw readings to a clean, gap-free hourly series per station."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.calendar import hour_index, index_hour, ntz, source_time
from isohyet.functions.weather import apply_ranges, repair_extremes, to_number, wind_u, wind_v
from isohyet.schemas import FILL_LIMIT, MEASURES, RANGE_RULES, SOURCE_OFFSET_HOURS, UNUSED_CHANNELS
from isohyet.session import small

RAW_MEASURES = ["rain", "ws", "wd", "td", "rh", "tdmax", "tdmin"]


def normalize_readings(df: DataFrame, time_col: str = "timestamp", offset_hours: int = SOURCE_OFFSET_HOURS,
                       keep: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """Source rows to raw rows: naive UTC time, numeric channels, unused columns gone."""
    df = df.drop(*UNUSED_CHANNELS)
    numeric = [c for c in df.columns if c != time_col and c not in keep]
    return df.select(
        *keep,
        source_time(F.col(time_col), offset_hours).alias("ts"),
        *[to_number(c).alias(c) for c in numeric],
    )


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the earliest by ``order``.

    An aggregate and not a window: copies of a hot key fold together before
    the shuffle, so no task ever receives them all.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the newest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*df.columns)


def newer_than_clean(readings: DataFrame, clean: DataFrame, scope: str = "station") -> DataFrame:
    """Raw rows of bins that the clean table does not hold yet.

    ``station`` compares with the newest clean hour of the same station and
    takes every later bin whole.  ``global`` compares with one mark over all
    stations and drops the reading that falls exactly on it.
    """
    if scope == "global":
        mark = clean.agg(F.max("hour").alias("m"))
        return readings.filter(F.col("ts") > F.coalesce(mark.scalar(), ntz("0001-01-01")))
    marks = small(clean.groupBy("station_id").agg(F.max(hour_index("hour")).alias("_mark")))  # a row a station
    return (
        readings.join(marks, "station_id", "left")
        .filter(F.col("_mark").isNull() | (hour_index("ts") > F.col("_mark")))
        .drop("_mark")
    )


def hourly_rollup(readings: DataFrame, bin_hours: int = 1, empty_rain: str = "zero") -> DataFrame:
    """Left-closed bins per station: rain summed, extremes kept, the rest averaged.

    Columns: station_id, h (bin index) and the eight measures.  The key holds
    the bin, and partial aggregation runs before the shuffle, so a station
    with a third of all readings is spread over its bins.
    """
    df = apply_ranges(readings, RANGE_RULES).withColumns({
        "u_vec": wind_u("ws", "wd"), "v_vec": wind_v("ws", "wd"), "h": F.floor(hour_index("ts") / bin_hours),
    })
    rain = "coalesce(sum(rain), 0D)" if empty_rain == "zero" else "sum(rain)"
    totals = {"rain": rain, "tdmax": "max(tdmax)", "tdmin": "min(tdmin)"}
    return df.filter("h IS NOT NULL").groupBy("station_id", "h").agg(
        *[F.expr(f"{totals.get(c, f'avg({c})')} AS {c}") for c in MEASURES]
    )


def fill_gaps(hourly: DataFrame, limit: int = FILL_LIMIT, key: str = "station_id",
              empty_rain: str = "zero", summed: tuple[str, ...] = ("rain",)) -> DataFrame:
    """Every bin from a station's first to its last, short gaps filled linearly.

    Each gap takes values for its first ``limit`` bins: on the line between
    the known values around it, or the last known value where none follows.
    Summed measures are 0 in bins without readings.

    The neighbours in time are looked up on the bins that exist, and only then
    is the series expanded, so the missing bins are never shuffled, joined or
    sorted.  A partition of the window is one station's bins, which the length
    of the archive bounds (8,766 a year), however many readings they came from.
    """
    measures = [c for c in hourly.columns if c not in (key, "h")]
    spread = [c for c in measures if c not in summed]
    w = f"PARTITION BY {key} ORDER BY h"
    known = {c: f"CASE WHEN {c} IS NOT NULL THEN struct(h, {c} AS v) END" for c in spread}
    df = hourly.selectExpr(
        "*", f"lead(h) OVER ({w}) AS _next_h",
        *[f"last({known[c]}, true) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _p_{c}" for c in spread],
        # one pass over the partition; a frame that starts at the next row would be quadratic
        *[f"lead({known[c]}) IGNORE NULLS OVER ({w}) AS _n_{c}" for c in spread],
    )
    df = df.selectExpr("*", "explode(sequence(h, coalesce(_next_h - 1, h))) AS g")

    def value(c):
        line = f"_p_{c}.v + (_n_{c}.v - _p_{c}.v) * CAST(g - _p_{c}.h AS DOUBLE) / CAST(_n_{c}.h - _p_{c}.h AS DOUBLE)"
        return f"CASE WHEN g - _p_{c}.h <= {limit} THEN CASE WHEN _n_{c} IS NULL THEN _p_{c}.v ELSE {line} END END AS {c}"

    bare = "0D" if empty_rain == "zero" else "NULL"
    total = {c: f"CASE WHEN g = h THEN {c} ELSE {bare} END AS {c}" for c in summed}
    return df.selectExpr(key, "g AS h", *[total.get(c) or value(c) for c in measures])


def hourly_clean(readings: DataFrame, dedupe_order: str | None = None, fill_limit: int = FILL_LIMIT,
                 bin_hours: int = 1, empty_rain: str = "zero") -> DataFrame:
    """Clean hourly table: station_id, hour, h and the eight measures.

    ``dedupe_order`` names the arrival order of readings; where given, the
    first of several readings with one (station_id, ts) counts.  Leave it out
    for a table that ``insert_ignore`` keeps unique, which saves a shuffle.
    """
    df = readings
    if dedupe_order:
        df = first_per_key(df, ["station_id", "ts"], dedupe_order)
    df = fill_gaps(hourly_rollup(df, bin_hours, empty_rain), fill_limit, empty_rain=empty_rain)
    return repair_extremes(df).select("station_id", index_hour(f"h * {bin_hours}").alias("hour"), "h", *MEASURES)


def closed_hours(hourly: DataFrame, now: datetime | str, ts: str = "hour") -> DataFrame:
    """Only hours that ended before ``now``."""
    limit = F.date_trunc("hour", ntz(now)).cast("timestamp_ntz")
    return hourly.filter(F.col(ts) < limit)


def missingness(df: DataFrame, channels: list[str], max_share: float, key: str = "station_id") -> DataFrame:
    """Share of nulls per station and channel, and whether the station is kept."""
    shares = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_missing") for c in channels],
    )
    return shares.withColumn("kept", F.greatest(*[F.col(f"{c}_missing") for c in channels]) <= max_share)


def quality_report(df: DataFrame, max_temperature: float) -> DataFrame:
    """Counts of broken rules over raw readings in one pass: rule, n_bad, n."""
    c = F.col
    rules = {
        "negative_rain": c("rain") < 0,
        "rh_out_of_range": (c("rh") < 0) | (c("rh") > 100),
        "negative_ws": c("ws") < 0,
        "too_hot": F.greatest("td", "tdmax", "tdmin") > max_temperature,
        "td_above_tdmax": c("td") > c("tdmax"),
        "td_below_tdmin": c("td") < c("tdmin"),
        **{f"{m}_null": c(m).isNull() for m in RAW_MEASURES},
    }
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_bad")) for r in rules]))
    return one.select("n", pairs.alias("p")).select("p.rule", "p.n_bad", "n")


def longest_segment(hourly: DataFrame, core: list[str], key: str = "station_id") -> DataFrame:
    """Longest unbroken run of hours with all core measures, per station.

    Ties go to the later run.  ``ends_at_end`` tells whether the run reaches
    the last hour of the whole table.
    """
    whole = F.lit(True)
    for c in core:
        whole = whole & F.col(c).isNotNull()
    rows = hourly.filter(whole).select(key, "h")
    w = Window.partitionBy(key).orderBy("h")
    runs = (
        rows.withColumn("_island", F.col("h") - F.row_number().over(w))
        .groupBy(key, "_island")
        .agg(F.min("h").alias("start_h"), F.max("h").alias("end_h"), F.count(F.lit(1)).alias("hours"))
    )
    best = runs.groupBy(key).agg(F.max(F.struct("hours", "end_h", "start_h")).alias("b"))
    end = hourly.agg(F.max("h").alias("h")).scalar()
    return best.select(
        key, F.col("b.hours").alias("hours"), F.col("b.start_h").alias("start_h"),
        F.col("b.end_h").alias("end_h"), (F.col("b.end_h") == end).alias("ends_at_end"),
    )

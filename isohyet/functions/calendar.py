"""Time rules.  Instants are naive UTC (TIMESTAMP_NTZ), hours also as an integer index."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.schemas import HORIZONS, LOCAL_ZONE, SOURCE_OFFSET_HOURS

EPOCH = datetime(1970, 1, 1)


def ntz(value: datetime | str) -> Column:
    """A literal naive instant."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def source_time(text: Column, offset_hours: int = SOURCE_OFFSET_HOURS) -> Column:
    """Naive UTC from a source text whose written offset is not to be trusted."""
    bare = F.regexp_replace(text, r"[+-]\d{2}:\d{2}$", "")
    return bare.try_cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(offset_hours))


def hour_index(ts: str) -> Column:
    """Whole hours since 1970, rounded down.  Needs no time zone for a naive instant."""
    return F.expr(f"CAST(datediff(CAST({ts} AS DATE), DATE'1970-01-01') AS BIGINT) * 24 + hour({ts})")


def index_hour(index: str = "h") -> Column:
    """Naive instant at which an hour index starts."""
    return F.expr(
        f"CAST(date_add(DATE'1970-01-01', CAST(floor(({index}) / 24D) AS INT)) AS TIMESTAMP_NTZ)"
        f" + make_dt_interval(0, CAST(pmod({index}, 24) AS INT))"
    )


def plus_hours(ts: Column, hours) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return ts + F.make_dt_interval(hours=hours.cast("int"))


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Civil time of a naive UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def cyclic_time(df, ts: str = "hour", zone: str = LOCAL_ZONE):
    """Add month and day of year as sine and cosine of the local calendar."""
    # the local time once per row, then its parts, then four waves
    parts = df.selectExpr("*", f"convert_timezone('UTC', '{zone}', {ts}) AS _local").selectExpr(
        "*", f"{2 * math.pi!r}D * month(_local) / 12 AS _month",
        f"{2 * math.pi!r}D * dayofyear(_local) / dayofyear(make_date(year(_local), 12, 31)) AS _day",
    )
    return parts.selectExpr(*[f"`{c}`" for c in df.columns], "sin(_month) AS month_sin", "cos(_month) AS month_cos",
                            "sin(_day) AS day_sin", "cos(_day) AS day_cos")


def horizon_times(df, ts: str = "hour", zone: str = LOCAL_ZONE, hours=HORIZONS):
    """One row per input and horizon (0 is now) with local label, time and weekday.

    Hours are added to the wall clock, so a label on the night of a clock
    change can differ by one hour from the converted UTC target.
    """
    steps = F.explode(F.array(*[F.lit(h) for h in [0, *hours]]))
    base = local_time(F.col(ts), zone)
    out = df.withColumn("horizon", steps).withColumn("_target", plus_hours(base, F.col("horizon")))
    return out.withColumns({
        "label": F.when(F.col("horizon") == 0, F.lit("Now")).otherwise(
            F.concat(F.lit("t+"), F.col("horizon").cast("string"), F.lit("h"))
        ),
        "local_time": F.date_format("_target", "yyyy-MM-dd HH:mm"),
        "clock": F.date_format("_target", "HH:mm"),
        "day": F.date_format("_target", "EEE"),
    }).drop("_target")


def text_time(ts: Column) -> Column:
    """Sortable text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")

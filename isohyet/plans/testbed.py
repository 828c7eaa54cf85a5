"""A sensor network laid over the driver's tables.

Users are sensors, five to a station, and events their readings; suppliers are
grid cells, customers are free points, parts are raster pixels.  Numbers are
sums of powers of two wherever possible, so that totals do not depend on the
order of addition.  ``oracles.py`` states the same views in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.calendar import plus_hours
from isohyet.operators.clean import hourly_clean
from isohyet.operators.interpolate import TRIO, idw_grid
from isohyet.operators.neighbors import available_cells, triangle_neighbors
from isohyet.schemas import HORIZONS
from isohyet.session import checkpoint_root, cut_lineage
from isohyet.sources.observations import read_payloads

UPSTREAM = {"west": 1, "north": 3}
HOLDOUT = 2
LOCAL_RADII = {"local": 3, "regional": 7}
PIXEL_COLUMNS = 50
PIXEL_ROWS = 40
NOW = "2024-01-31 00:20:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return as_readings(table(spark, sf, "events"))


def as_readings(events: DataFrame) -> DataFrame:
    """Raw readings with a rain sentinel, impossible winds and humidities, and broken extremes."""
    k, value, kind, event = F.col("k"), F.col("value"), F.col("event_type"), F.col("event_id")
    df = events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("double"))
    base = k % 20 + 10
    return df.select(
        "event_id", (F.floor(F.col("user_id") / 5) + 1).alias("station_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(kind == "purchase", F.floor(value) / 4).when((kind == "error") & (k < 20), F.lit(-59994.0))
        .otherwise(0.0).alias("rain"),
        F.when((kind == "signup") & (k < 10), F.lit(-1.0)).otherwise(F.floor(value) / 2).alias("ws"),
        (k * 3.6).alias("wd"), base.alias("td"), (k * 1.25 - 3).alias("rh"),
        (base + event % 3 - 0.5).alias("tdmax"), (base - event % 4 + 0.5).alias("tdmin"),
    )


def _place(key: Column, first: int, second: int) -> tuple[Column, Column]:
    lat = 32 + (key * key * first + key * 31) % 10007 / F.lit(10007.0)
    lon = 35 + (key * second + 5) % 10009 / F.lit(10009.0)
    return lat, lon


def _statics(key: Column, lon: Column) -> dict[str, Column]:
    return {
        "elevation": (key * 37) % 100 * 10.0 - 50.0, "tpi_local": (key * 13) % 64 / 4 - 8.0,
        "tpi_regional": (key * 29) % 128 / 4 - 16.0, "roughness_local": (key * 7) % 32 / 2 + 1.0,
        "roughness_regional": (key * 11) % 64 / 2 + 2.0, "dist_to_coast": (lon - 34.95) * 93,
    }


def stations(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "events").select((F.floor(F.col("user_id") / 5) + 1).alias("station_id")).distinct()
    lat, lon = _place(F.col("station_id"), 7919, 4639)
    return ids.withColumns({"latitude": lat, "longitude": lon}).withColumns(
        _statics(F.col("station_id"), F.col("longitude"))
    )


def stored_stations(spark: SparkSession, sf: str) -> DataFrame:
    """The station table; searches read it several times, the readings behind it are read once."""
    return cut_lineage(stations(spark, sf))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("cell_id"))
    lat, lon = _place(F.col("cell_id"), 6101, 3571)
    return ids.withColumns({"lat": lat, "lon": lon}).withColumns(_statics(F.col("cell_id"), F.col("lon")))


def points(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("cell_id"))
    lat, lon = _place(F.col("cell_id"), 3889, 7253)
    return ids.withColumns({"lat": lat, "lon": lon})


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Landed source documents: wrong offset text, mixed case, invalid, unknown and repeated channels."""
    df = readings(spark, sf)
    valid = F.col("event_id") % 7 != 0

    def channel(name, value, ok=valid):
        return F.struct(F.lit(name).alias("name"), ok.alias("valid"), value.alias("value"))

    listed = F.concat(
        F.array(
            channel("Rain", F.col("rain")), channel("WS", F.col("ws"), F.lit(True)), channel("wd", F.col("wd")),
            channel("TD", F.col("td"), F.lit(True)), channel("RH", F.col("rh")), channel("Grad", F.col("rh")),
            channel("TDmax", F.col("tdmax"), F.lit(True)), channel("TDmin", F.col("tdmin"), F.lit(True)),
        ),
        F.when(F.col("event_id") % 11 == 0, F.array(channel("rain", F.col("rain") + 1, F.lit(True)))).otherwise(
            F.expr("CAST(array() AS array<struct<name:string,valid:boolean,value:double>>)")
        ),
    )
    text = F.concat(F.date_format(plus_hours(F.col("ts"), 2), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    doc = F.to_json(F.struct(
        F.col("station_id").alias("stationId"),
        F.array(F.struct(text.alias("datetime"), listed.alias("channels"))).alias("data"),
    ))
    landed = f"{checkpoint_root(spark)}/landed-{uuid.uuid4().hex}"
    df.select(doc.alias("value")).write.text(landed)
    return read_payloads(spark, landed)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_clean(readings(spark, sf), dedupe_order="event_id")


def stored_clean(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(clean(spark, sf))


def neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbour table, which is stored once and read by all that follows."""
    c = cells(spark, sf)
    found = triangle_neighbors(c, stored_stations(spark, sf)).drop("lat", "lon")
    return cut_lineage(c.join(found, "cell_id"))


def interpolated(spark: SparkSession, sf: str, hourly: DataFrame | None = None) -> DataFrame:
    return idw_grid(neighbors(spark, sf), hourly if hourly is not None else stored_clean(spark, sf))


def stored_grid(spark: SparkSession, sf: str, hourly: DataFrame | None = None) -> DataFrame:
    return cut_lineage(interpolated(spark, sf, hourly))


def newest_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Only the newest hour of the grid: it is looked up in the series, and no other hour is interpolated."""
    hourly, near = stored_clean(spark, sf), neighbors(spark, sf)
    usable = cut_lineage(available_cells(near, hourly))
    members = usable.select(F.explode(F.array(*TRIO)).alias("station_id")).distinct()
    newest = hourly.join(members, "station_id", "left_semi").agg(F.max("h")).scalar()
    return idw_grid(usable, cut_lineage(hourly.filter(F.col("h") == newest)), checked=False)


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """One forecast row per cell from its newest hour with rain; every thirteenth is an hour older."""
    grid = interpolated(spark, sf).select("cell_id", "hour", "rain")
    newest = grid.groupBy("cell_id").agg(F.max("hour").alias("hour"), F.max_by("rain", "hour").alias("rain"))
    share = dict(zip(HORIZONS, (0.875, 0.75, 0.5, 0.25)))
    late = F.when(F.col("cell_id") % 13 == 0, plus_hours(F.col("hour"), -1)).otherwise(F.col("hour"))
    return newest.select("cell_id", late.alias("hour"),
                         *[(F.col("rain") * share[n]).alias(f"precipitation_t{n}") for n in HORIZONS])


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    at = F.floor(F.col("p_partkey") / PIXEL_COLUMNS)
    return table(spark, sf, "part").select(
        F.floor(at / PIXEL_ROWS).alias("tile"), (at % PIXEL_ROWS).alias("row"),
        (F.col("p_partkey") % PIXEL_COLUMNS).alias("col"),
        F.when(F.col("p_size") != 13, F.col("p_size") * 10).alias("elev"),
    )


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    i, j = F.floor(F.col("p_partkey") / PIXEL_COLUMNS), F.col("p_partkey") % PIXEL_COLUMNS
    return table(spark, sf, "part").select(
        i.alias("lat_idx"), j.alias("lon_idx"), F.round(32.2 + i / 100, 6).alias("lat"),
        F.round(35.1 + j / 100, 6).alias("lon"), F.floor("p_retailprice").cast("double").alias("dist"),
    )

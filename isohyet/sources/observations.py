"""Landed station payloads, the station catalogue, the archive and static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.schemas import ARCHIVE, CATALOG, CHANNELS, PAYLOAD
from isohyet.session import read_or_empty


def read_payloads(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                  stream: bool = False, multi_line: bool = False) -> DataFrame:
    """Payload documents; with a ``date`` partition the range [start, end) prunes folders.

    One document per line is splittable and the default; ``multi_line`` reads
    files that hold one pretty-printed document each.
    """
    reader = (spark.readStream if stream else spark.read).schema(PAYLOAD)
    df = reader.option("multiLine", multi_line).json(path)
    if start is not None:
        df = df.filter(F.col("date") >= start)
    if end is not None:
        df = df.filter(F.col("date") < end)
    return df


def flatten_observations(payloads: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """One row per observation with one column per known channel.

    A channel counts where ``valid`` is true; names match in lower case; of
    repeated channels the last valid one wins; others are null.  No shuffle.
    """
    obs = payloads.selectExpr("stationId AS station_id", "explode(data) AS o")
    usable = obs.selectExpr("station_id", "o.datetime AS timestamp", "reverse(filter(o.channels, c -> c.valid)) AS ch")
    named = usable.selectExpr("station_id", "timestamp", "transform(ch, c -> lower(c.name)) AS names", "ch.value AS vals")
    # the first match in reverse order; position 0 (no match) gives null
    return named.selectExpr("station_id", "timestamp", *[f"get(vals, CAST(array_position(names, '{c}') - 1 AS INT)) AS {c}" for c in channels])


def station_catalog(raw: DataFrame) -> DataFrame:
    """Stations whose name holds no digit: station_id, name, file_name, latitude, longitude."""
    return raw.filter(~F.col("name").rlike("[0-9]")).select(
        F.col("stationId").alias("station_id"), "name",
        F.translate("name", " ", "_").alias("file_name"),
        F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return station_catalog(spark.read.schema(CATALOG).option("multiLine", True).json(path))


def with_coordinates(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings of stations that have coordinates, with these attached."""
    placed = stations.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return readings.join(placed.select("station_id", "latitude", "longitude"), "station_id")


def without_coordinates(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Ids that send readings but are skipped for lack of coordinates."""
    placed = stations.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return readings.select("station_id").distinct().join(placed, "station_id", "left_anti")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """CSV archive with a header, one folder per station or plain files."""
    return spark.read.schema(ARCHIVE).option("header", True).csv(path)


def write_archive(rows: DataFrame, path: str, mode: str = "append") -> None:
    """CSV archive, one folder per station.

    Rows are gathered by station first, so that not every task writes to every
    folder; adaptive execution splits a big station over several writers.
    """
    columns = ["station_id", "timestamp", "latitude", "longitude", *CHANNELS]
    rows.select(*[c for c in columns if c in rows.columns]).hint("rebalance", "station_id").write.mode(mode).partitionBy("station_id").option(
        "header", True
    ).option("maxRecordsPerFile", 5_000_000).option("partitionOverwriteMode", "dynamic").csv(path)


def bootstrap(spark: SparkSession, json_path: str, table_path: str, schema) -> bool:
    """Fill a static table from its JSON document if it is empty or absent; True if it did."""
    if not read_or_empty(spark, table_path, schema).isEmpty():
        return False
    spark.read.schema(schema).option("multiLine", True).json(json_path).write.mode("overwrite").parquet(table_path)
    return True


def export_json(df: DataFrame, path: str, order: list[str]) -> None:
    """Ordered JSON lines: files and lines follow the order (range partitioning, parallel writers)."""
    df.orderBy(*order).write.mode("overwrite").json(path)

"""Keyed tables without a MERGE: insert-ignore, upsert, trim, resumable loads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.calendar import ntz, plus_hours
from isohyet.operators.clean import first_per_key, latest_per_key
from isohyet.session import read_or_empty


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str], order: str,
             time_col: str | None = None) -> DataFrame:
    """Rows of a batch that insert-ignore would add: the first per key, unknown to the target.

    With ``time_col`` (one of the keys) only the target's part between the
    batch's first and last time is read: the bounds are sub-queries, which
    prune files and row groups.
    """
    known = target
    if time_col:
        known = known.filter(F.col(time_col).between(
            batch.agg(F.min(time_col)).scalar(), batch.agg(F.max(time_col)).scalar()
        ))
    return first_per_key(batch, keys, order).join(known.select(*keys), keys, "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: str,
                  time_col: str | None = None) -> DataFrame:
    """The target after an append that keeps existing keys."""
    return target.unionByName(new_rows(target, batch, keys, order, time_col).select(*target.columns))


def upsert_latest(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The target with each key of the batch replaced by its newest row there; other keys stay."""
    newest = latest_per_key(batch, keys, order)
    return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*target.columns))


def retention_trim(df: DataFrame, now: datetime | str, hours: int, ts: str = "hour") -> DataFrame:
    """Rows of the last ``hours`` before ``now``."""
    return df.filter(F.col(ts) >= plus_hours(ntz(now), -hours))


def with_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the date partition column."""
    return df.withColumn("date", F.col(ts).cast("date"))


def write_partitioned(df: DataFrame, path: str, mode: str = "append", ts: str = "ts") -> None:
    """Write by date.  Each date's rows spread over as many writers as adaptive execution finds useful."""
    with_date(df, ts).hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Full replace; ids come from the data, so there is no counter to reset."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def pending(catalog: DataFrame, manifest: DataFrame, key: str = "station_id") -> DataFrame:
    """Catalogue entries that the manifest does not list as done."""
    return catalog.join(manifest.select(key), key, "left_anti")


def manifest_rows(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Manifest entries of loaded stations: station_name, station_id, total_rows (0 without rows)."""
    counts = rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("total_rows"))
    return catalog.join(counts, "station_id", "left").select(
        F.col("name").alias("station_name"), "station_id", F.coalesce("total_rows", F.lit(0)).alias("total_rows")
    )


def backfill(spark: SparkSession, catalog: DataFrame, rows: DataFrame, archive_path: str,
             manifest_path: str) -> DataFrame:
    """Append the stations that are not in the manifest yet, then list them there.

    A run that dies between the two writes repeats its stations: their folders
    are overwritten, so a repeat adds nothing twice.
    """
    from isohyet.sources.observations import write_archive

    schema = "station_name string, station_id long, total_rows long"
    todo = pending(catalog, read_or_empty(spark, manifest_path, schema))
    mine = rows.join(todo.select("station_id", "latitude", "longitude"), "station_id")
    done = manifest_rows(mine, todo)
    write_archive(mine, archive_path, mode="overwrite")
    done.write.mode("append").parquet(manifest_path)
    return spark.read.schema(schema).parquet(manifest_path)

"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# AQE does the run-time work: it broadcasts a join side only after measuring
# it, splits skewed join partitions and merges small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "isohyet", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or get) a session with the library defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for cut lineage: the one the cluster names, else one of our own.

    Our own is a local folder and is only taken on a ``local`` master, where
    driver and executors share a disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isohyet-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back.

    For results with several consumers: they are computed once, later plans
    stay short, pruning and size estimates work on the columnar files, and a
    lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/isohyet-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` stored and, if it has no more than ``rows`` rows, marked for broadcast.

    For one row a station, class or group beside a big table: the size is counted, and a table
    beyond it joins in the ordinary way.
    """
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= rows else stored


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system that Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the partition folders ``key=value`` right below a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return [n[len(key) + 1:] for n in names if n.startswith(f"{key}=")]


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder; false where there was none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or no rows where it has not been written yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over all cores by ``keys``, ahead of a step that multiplies its rows.

    Adaptive execution sizes partitions by their input; a small input that
    grows a hundredfold in the next step would otherwise land in few tasks.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    if not spark.sparkContext.master.startswith("local"):  # on a cluster partitions also have to fit in memory
        wanted = max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *keys)

"""A keyed table kept as whole snapshots, replaced in one step.

Below the table's path: ``data/<name>``, one folder of Parquet files a snapshot, and ``versions/<number>``, one small file a version that
names its folder.  A writer first writes its data, then moves the file of the next version into place, which fails if another writer
has done so: of two writers that started from one version one wins, and the other starts anew from what it finds.
Readers see the highest version and nothing of an unfinished one.  The move has to be atomic and must not overwrite, as on
HDFS and local disks; on stores without that, let one writer at a time in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from isohyet.session import remove
from isohyet.sources.tables import upsert_latest


class Conflict(Exception):
    """Another writer has made the version that this one was about to make."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def folder(self, version: int) -> str:
        place = self._place(f"versions/{version:012d}")
        stream = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(place)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{self.folder(version)}")

    def write(self, rows: DataFrame) -> str:
        """First step: the data of a snapshot that nobody reads yet."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def publish(self, name: str, version: int) -> None:
        """Second step: make the folder ``name`` that version; ``Conflict`` if there is one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        made, wanted = self._place(f"tmp/{name}"), self._place(f"versions/{version:012d}")
        system = made.getFileSystem(conf)
        system.mkdirs(wanted.getParent())
        stream = system.create(made)
        stream.writeUTF(name)
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(made).toUri(), conf)
        try:
            context.rename(system.makeQualified(made), system.makeQualified(wanted), options)
        except Exception as failed:
            if system.exists(wanted):
                raise Conflict(f"{self.path}: version {version} exists") from failed
            raise

    def replace(self, rows: DataFrame) -> int:
        """A snapshot of ``rows``, whatever was there before."""
        return self._commit(lambda _: rows)

    def upsert(self, batch: DataFrame, keys: list[str], order: str) -> int:
        """The newest snapshot with each key of the batch replaced by its newest row there."""
        return self._commit(lambda table: upsert_latest(table, batch, keys, order))

    def _commit(self, change, tries: int = 10) -> int:
        for _ in range(tries):
            version = self.version()
            name = self.write(change(self.read(version)))
            try:
                self.publish(name, version + 1)
                return version + 1
            except Conflict:
                remove(self.spark, f"{self.path}/data/{name}")
        raise Conflict(f"{self.path}: gave up after {tries} tries")

    def clean(self, keep: int = 2) -> int:
        """Delete versions but the newest ``keep`` and the folders that no version names; run it while nobody writes."""
        numbers = [int(n) for n in self._names("versions") if n.isdigit()]
        named = {self.folder(n) for n in numbers[-keep:]}
        gone = sum(remove(self.spark, f"{self.path}/data/{n}") for n in self._names("data") if n not in named)
        for n in numbers[:-keep]:
            remove(self.spark, f"{self.path}/versions/{n:012d}")
        remove(self.spark, f"{self.path}/tmp")
        return gone

"""Keys of earlier runs in a bucketed table, so that a run moves its own rows and never the history.

The table is Parquet under a folder, bucketed by its key, with a partition for each run. A run's rows are dealt to the same buckets and joined
there: no exchange on the history's side, whatever its size. What a run adds overwrites that run's partition, so a run that is repeated after a
failure leaves one copy, and compaction of many small runs into one is a run like any other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def mkdirs(self) -> None:
        self.fs.mkdirs(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)


class KeyStore:
    """Keys under `path`. Rows with a null key are never new and are never stored."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", kind: str = "string", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.table = f"kbforge_keys_{hashlib.md5(self.path.encode()).hexdigest()}"
        self._folder("").mkdirs()
        # the session's catalog may be new, or have the table from before
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        spark.sql(f"CREATE TABLE {self.table} (`{key}` {kind}, `run` string) USING parquet OPTIONS ('partitionOverwriteMode'='dynamic') PARTITIONED BY (`run`) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        spark.catalog.recoverPartitions(self.table)

    def _folder(self, below: str) -> "_Folder":
        return _Folder(self.spark, self.path + below)

    def keys(self, besides: str | None = None) -> DataFrame:
        """All keys, once for each run that has them; besides: without those of a run."""
        rows = self.spark.table(self.table)
        return (rows if besides is None else rows.where(F.col("run") != besides)).select(self.key)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows in the store's buckets: joins and groups by the key need no further exchange."""
        return rows.repartition(self.buckets, self.key)

    def new(self, rows: DataFrame, run: str | None = None) -> DataFrame:
        """Rows whose key no run has; run: those of this run don't count, so that a repeated run finds what it found before."""
        return self.dealt(rows.where(F.col(self.key).isNotNull())).join(self.keys(run), self.key, "left_anti")

    def add(self, rows: DataFrame, run: str) -> None:
        """Stores the keys of rows that other runs lack as those of `run`, in place of what that run had stored."""
        fresh = self.new(rows.select(self.key), run).distinct().withColumn("run", F.lit(run))
        fresh.write.mode("overwrite").insertInto(self.table)

    def compact(self, into: str) -> None:
        """All keys as those of one run: one sorted file a bucket again."""
        runs = [r.run for r in self.spark.table(self.table).select("run").distinct().collect()]
        if not runs or runs == [into]:
            return
        if into in runs:
            raise ValueError(f"{into} is a run of this store")
        self.spark.table(self.table).select(self.key, F.lit(into).alias("run")).distinct().write.mode("overwrite").insertInto(self.table)
        for run in runs:
            self.spark.sql(f"ALTER TABLE {self.table} DROP PARTITION (run = '{run}')")
            self._folder(f"/run={run}").delete()

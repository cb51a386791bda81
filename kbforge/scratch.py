"""Lineage cuts: tables written to the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a temporary folder that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kbforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and read back from shared storage; survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kbforge-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_later(spark: SparkSession, path: str) -> None:
    """Has a folder deleted with the written tables."""
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))


def mark() -> int:
    """A point in the list of written tables, for drop_written."""
    return len(_written)


def drop_written(since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written after a mark but for the last `keep` ones: call when no result that reads them is used any more."""
    kept = _written[len(_written) - keep :] if keep else []
    del _written[len(_written) - keep :]
    while len(_written) > since:
        spark, path = _written.pop()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.extend(kept)


def _clean() -> None:
    try:
        drop_written()
    except Exception:  # the JVM has gone before Python: the folder's owner clears it
        _written.clear()

"""Incremental dedup with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.functions.text import content_hash


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(content_hash(F.col(text)).alias("content_hash"))


def run_available(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, text: str = "text") -> None:
    """Appends the content hashes that earlier runs under this checkpoint have not seen to `out`, then stops. State is one key a hash."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = hashed(stream, text).dropDuplicates(["content_hash"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()

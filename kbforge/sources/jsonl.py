"""JSON lines: tolerant and strict scans, the loader of question-answer items, the append sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.functions.text import ANSWER_KEYS, QUESTION_KEYS, index_text, pick_first, strip


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, value) of the lines of a file (or of a folder's files in the order of their names), numbered from 0; no rows if it is missing.

    Files are read in splits. A line's place is its place in its split and the lines of all splits before it: one row a split is summed
    and joined back, the lines themselves aren't moved."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "ord bigint, value string")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n")
    shift = splits.select("_file", "_start", (before - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(shift), ["_file", "_start"]).select((F.col("_at") + F.col("_shift")).alias("ord"), "value")


def with_status(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with `status`: blank, bad or ok, and `json` as a variant where ok."""
    v = F.col(value)
    # the parser stops after one value; within two kinds of brackets, what follows it must be nothing
    whole = F.try_parse_json(F.concat(F.lit("["), strip(v), F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), strip(v), F.lit("}"))).isNotNull()
    parsed = F.when(whole, F.try_parse_json(strip(v)))
    return rows.withColumn("json", parsed).withColumn("status", F.when(strip(F.coalesce(v, F.lit(""))) == "", "blank").when(F.col("json").isNull(), "bad").otherwise("ok"))


def scan_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """The lines that parse; blank and bad ones are passed over. with_status(lines(...)) counts these."""
    return with_status(lines(spark, path)).where("status = 'ok'").select("ord", "value", "json")


def scan_strict(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Fails on a line that doesn't parse."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def qa_items(rows: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """Rows (id, question, answer, index_text, raw) of the lines that parse; id is the line's number, so ids have gaps.
    A record under none of the known names is its own answer, and its first 300 characters the question."""
    good = with_status(rows, value).where("status = 'ok'")
    field = lambda k: F.get_json_object(strip(F.col(value)), f"$.{k}")
    question, answer = pick_first(*map(field, QUESTION_KEYS)), pick_first(*map(field, ANSWER_KEYS))
    neither = (F.col("q") == "") & (F.col("a") == "")
    raw = strip(F.col(value))
    out = good.select(F.col(order).alias("id"), question.alias("q"), answer.alias("a"), raw.alias("raw"))
    q: Column = F.when(neither, F.substring("raw", 1, 300)).otherwise(F.col("q"))
    a: Column = F.when(neither, F.col("raw")).otherwise(F.col("a"))
    return out.select("id", q.alias("question"), a.alias("answer"), "raw").withColumn("index_text", index_text(F.col("question"), F.col("answer")))

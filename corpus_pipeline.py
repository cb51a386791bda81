"""Raw documents to packed training sequences: quality rules, near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return the
columns of documents, with n_chars as the length of the text they leave. Null texts are rejected by the first stage; rows
with a null doc_id, and texts that share one, are documents of their own throughout. Empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import near_dedup, packing, pii, quality_rules, substring_dedup
from kbforge.llm.scratch import drop_written, mark, written


def _with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """Rows with the whole document in column _row to documents with another text."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in columns])


def _whole(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go; failing lines of the others are removed."""
    judged = quality_rules.line_first_quality(docs.select("doc_id", "text", _whole(docs))).where("quality.kept")
    same = F.col("quality.n_good_lines") == F.col("quality.n_lines")
    return _with_text(judged, docs.columns, F.when(same, F.col("text")).otherwise(F.col("quality.cleaned")))


def once(docs: DataFrame) -> DataFrame:
    """docs without repeated rows. Only rows whose doc_id comes again are compared."""
    again = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    again = written(again, "repeated-ids")
    n = again.count()
    if not n:
        return docs
    if n <= substring_dedup.BROADCAST_IDS:
        again = F.broadcast(again)  # all other texts stay where they are
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    some = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(again, same, "left_anti").unionByName(some)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, and one row of those with the same doc_id and text. Texts that share a doc_id, or have none, are documents of their own."""
    rows = substring_dedup.keyed(once(docs).select("doc_id", "text", _whole(docs)))
    found = near_dedup.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(gone, "_key", "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere are cut out of every document that holds them."""
    rows = substring_dedup.keyed(docs.select("doc_id", "text", _whole(docs)))
    cut = substring_dedup.remove_repeats(rows.select(F.col("_key").alias("doc_id"), "text")).where("n_removed > 0").select(F.col("doc_id").alias("_key"), "kept_text").dropDuplicates(["_key"])
    rows = rows.join(cut, "_key", "left")
    return _with_text(rows, docs.columns, F.coalesce("kept_text", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to their kind in angle brackets."""
    return _with_text(pii.redact(docs.select("doc_id", "text", _whole(docs))), docs.columns, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 token ids by lexical retrieval."""
    return packing.op2(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed),
]

#: Token ids can't be computed in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(begin, keep=1)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)

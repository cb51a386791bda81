"""Question-answer records: validity, provenance, state of earlier runs, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.functions.text import content_hash, evidence, question_id, strip
from kbforge.functions.urls import url_norm, url_norm_base
from kbforge.operators.dedup import keep_first, not_in_history


def qa_valid(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Pairs whose stripped question and answer have `least` characters each, stripped."""
    out = pairs.withColumn("question", strip(F.coalesce("question", F.lit("")))).withColumn("answer", strip(F.coalesce("answer", F.lit(""))))
    return out.where((F.length("question") >= least) & (F.length("answer") >= least))


def qa_records(pairs: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs(doc_id, chunk_id, question, answer, category, evidence), their chunks and documents to full records."""
    rows = pairs.join(chunks, ["doc_id", "chunk_id"]).join(docs.select("doc_id", F.col("url").alias("_u"), F.col("title").alias("_t"), F.col("category").alias("_c")), "doc_id")
    return rows.select(
        "question", "answer", F.coalesce(F.nullif("category", F.lit("")), "_c", F.lit("other")).alias("category"), evidence(F.col("evidence"), F.col("chunk")).alias("evidence"),
        F.concat("_t", F.lit(" - chunk "), F.col("chunk_id").cast("string")).alias("source_title"), F.col("_u").alias("source_url"),
        question_id(F.lit(None).cast("string"), F.col("question")).alias("id"), "chunk_id", F.col("doc_id").alias("source_doc_id"),
    )


_PAIR = "struct<question:string,answer:string,category:string,source_title:string,source_url:string,evidence:string>"


def synthesized(rows: DataFrame, order: str, known: DataFrame | None = None) -> DataFrame:
    """rows(ord, chunk_id, chunk, reply, doc_id, url, title, ai_category), a reply being {"qa_pairs": [...]}, to records: no pair,
    one or many from a chunk. Invalid pairs go; of a question that comes again the first in (ord, chunk, pair) stays, unless known(id) has it.
    What a pair leaves out comes from its document and chunk."""
    pairs = rows.select("*", F.posexplode(F.from_json("reply", "struct<qa_pairs:array<string>>")["qa_pairs"]).alias("_pair", "_one"))
    pairs = pairs.withColumn("_p", F.from_json("_one", _PAIR)).drop("_one").where("_p IS NOT NULL")  # one by one: what is no object goes alone
    pairs = qa_valid(pairs.drop("reply").withColumns({"question": F.col("_p.question"), "answer": F.col("_p.answer")}))
    made = pairs.select(
        F.struct(F.col(order).cast("bigint"), F.col("chunk_id").cast("bigint"), F.col("_pair").cast("bigint")).alias("_at"), "question", "answer",
        F.coalesce("_p.category", "ai_category", F.lit("other")).alias("category"), evidence(F.col("_p.evidence"), F.col("chunk")).alias("evidence"),
        F.coalesce("_p.source_title", F.concat("title", F.lit(" - chunk "), F.col("chunk_id").cast("string"))).alias("source_title"),
        F.coalesce("_p.source_url", "url").alias("source_url"), question_id(F.lit(None).cast("string"), F.col("question")).alias("id"), "chunk_id", F.col("doc_id").alias("source_doc_id"),
    )
    if known is not None:
        made = not_in_history(made, known, ["id"])
    return keep_first(made, "id", "_at").drop("_at")


def load_failures(failed: DataFrame) -> DataFrame:
    """Keys (url, reason) of earlier failures, URLs normalized."""
    return failed.where("url <> '' AND reason <> ''").select(url_norm(F.col("url")).alias("url"), "reason").distinct()


def load_state(raw: DataFrame, qa: DataFrame, trust_stored: bool = True) -> dict[str, DataFrame]:
    """Keys of earlier runs: normalized urls, content hashes (stored ones trusted or taken anew) and question ids."""
    stored = F.nullif(F.col("content_hash"), F.lit(""))
    fresh = F.when(F.coalesce("content", F.lit("")) != "", content_hash(F.col("content"), 12000 if trust_stored else 8000))
    hashes = raw.select((F.coalesce(stored, fresh) if trust_stored else fresh).alias("content_hash")).where("content_hash IS NOT NULL").distinct()
    urls = raw.select((url_norm if trust_stored else url_norm_base)(F.col("url")).alias("url")).where("url <> ''").distinct()
    questions = qa.where("question <> ''").select(question_id(F.col("id") if trust_stored else F.lit(None).cast("string"), F.col("question")).alias("id")).distinct()
    return {"urls": urls, "content_hashes": hashes, "questions": questions}


def qa_lineage(qa: DataFrame, docs: DataFrame) -> DataFrame:
    return qa.join(docs, qa["source_doc_id"] == docs["doc_id"])


def crawl_summary(statuses: DataFrame, status: str = "status", records: DataFrame | None = None, discovered: DataFrame | None = None) -> DataFrame:
    """One row: pages seen, useful documents, skipped ones; with records and discovered URLs given, new_qa and discovered too."""
    out = statuses.agg(F.count("*").alias("pages"), F.count_if(F.col(status) == "kept").alias("useful"), F.count_if(F.col(status) != "kept").alias("skipped"))
    for name, rows in (("new_qa", records), ("discovered", discovered)):
        if rows is not None:
            out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row each
    return out

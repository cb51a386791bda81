"""Whole flows: documents to an index, questions to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.config import Config
from kbforge.functions.text import query_prefix, rerank_doc_text, strip
from kbforge.operators import retrieval
from kbforge.sources import connectors


def build_index(items: DataFrame, path: str, embed: Callable, model_name: str = "offline") -> None:
    """items(id, question, answer, index_text, raw) with vectors to path/items, and one row of facts to path/meta."""
    if items.isEmpty():
        raise ValueError("no items to index")
    # the generator keeps the model's call out of the expressions above it
    vectors = items.select("*", F.explode(F.array(embed(F.col("index_text")))).alias("_v"))
    vectors = vectors.withColumn("embedding", retrieval.l2_normalize(F.col("_v")).cast("array<float>")).drop("_v")
    vectors.write.mode("overwrite").parquet(f"{path}/items")
    written = items.sparkSession.read.parquet(f"{path}/items")
    meta = written.agg(F.count("*").alias("num_items"), F.max(F.size("embedding")).alias("dimension"))
    meta.select(F.lit(model_name).alias("embedding_model"), F.lit("exact inner product").alias("index_type"), "num_items", "dimension").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/items")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/items")


#: Words that end a session (fixed values).
EXIT_WORDS = ("exit", "quit", "q")


def asking(questions: DataFrame) -> DataFrame:
    """Questions that want an answer: neither blank nor an exit word."""
    q = F.lower(strip(F.coalesce("question", F.lit(""))))
    return questions.where((q != "") & ~q.isin(*EXIT_WORDS))


def ask(index: DataFrame, questions: DataFrame, embed: Callable, score: Callable, complete: connectors.ChatCompleter, config: Config = Config()) -> DataFrame:
    """questions(query_id, question) to rows (query_id, reply). Blank questions and the words that end a session have none."""
    asked = asking(questions).withColumn("embedding", embed(query_prefix(config.query_task, F.col("question"))))
    hits = retrieval.knn_topk_batch(index, asked.select("query_id", "embedding"), config.top_k, "id")
    hits = hits.join(index.drop("embedding"), "id")
    null = F.lit(None).cast("string")
    if config.use_reranker:
        text = rerank_doc_text(F.col("question"), F.col("answer"), F.col("index_text"), *(F.get_json_object("raw", f"$.{k}") for k in ("category", "source_title", "source_url")))
        pairs = hits.join(asked.select("query_id", F.col("question").alias("_asked")), "query_id").withColumn("rerank_score", score(F.col("_asked"), text))
        best = retrieval.rerank_topn(pairs.drop("_asked"), config.rerank_top_n)
    else:
        best = retrieval.topn_no_rerank(hits, config.rerank_top_n).withColumns({"faiss_rank": F.col("rank"), "faiss_score": F.col("score"), "rerank_score": null.cast("double")})
    context = retrieval.build_context(best).join(asked.select("query_id", "question"), "query_id")
    requests = context.select(F.col("query_id").alias("id"), retrieval.chat_messages(F.col("question"), F.col("context")).alias("messages"))
    answers = connectors.generate(requests, complete).select(F.col("id").cast("long").alias("query_id"), "answer")
    return retrieval.answer_with_sources(best, answers)

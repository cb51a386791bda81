"""Exact vector search, reranking, and the contexts that a generator reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbforge.functions.text import labelled, strip
from kbforge.scratch import written

TOP_K, TOP_N = 30, 5
#: Decimal places at which scores are compared, so that equal vectors tie.
PLACES = 6
#: Cells of an index, items that their centres are found by, and files of a large cell.
MAX_CELLS, CELL_SAMPLE, CELL_FILES = 4096, 50_000, 8
#: Bytes of query vectors and of their best items that a task holds in one pass; more queries take more passes.
QUERY_BYTES = 32 << 20
#: Products that are held at a time, and items of a step: a worker's memory follows neither the queries nor the items.
SCORES, STEP = 1 << 20, 4096
CUT_NOTICE, CUT_NOTICE_SEARCH = "\n\n[提示：后续参考资料因长度限制已截断]", "\n\n[提示：后续资料因长度限制已截断]"

#: What a generator is told.
SYSTEM = "你是一个严谨的中文问答助手。你必须优先根据给定参考资料回答问题。如果参考资料中没有足够信息，请回答“根据现有资料无法确定”。不要编造参考资料中不存在的内容。回答要清晰、简洁、准确。"
USER_HEAD, USER_MIDDLE = "请根据下面参考资料回答问题。\n\n参考资料：\n", "\n\n用户问题：\n"
USER_TAIL = "\n\n回答要求：\n1. 优先依据参考资料。\n2. 如果资料不足，回答“根据现有资料无法确定”。\n3. 不要编造学校政策、时间、地点、数字等信息。\n4. 用中文回答，简洁准确。"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(c: Column, places: int) -> Column:
    """A double at so many places as C and SQL engines round it, half away from zero in binary: F.round takes the shortest decimal instead, so
    0.5105, whose thousandfold is just below 510.5, becomes 0.511 there and 0.51 here. A negative zero stays one; what would overflow stays as it is."""
    many = c * 10.0**places
    whole = F.when(many > 0, F.round(many)).when(many < 0, -F.round(-many)).otherwise(many)
    return F.when(F.abs(many) == float("inf"), c).otherwise(whole / 10.0**places)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is. The norm is taken once a row."""
    return F.transform(F.array(l2_norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def last_token_pool(states: Column, mask: Column, left_padded: Column) -> Column:
    """The last state of left-padded rows, else the one at the mask's last one."""
    count = F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(left_padded, F.element_at(states, -1)).otherwise(F.get(states, count - 1))


def padded_left(mask: Column, batch: list[Column]) -> Column:
    """Whether the rows of a batch are padded on the left: the mask's last place is set in every one of them."""
    return F.min(F.coalesce(F.element_at(mask, -1), F.lit(0)).cast("int")).over(Window.partitionBy(*batch)) == 1


def knn_topk(items: DataFrame, query: list[float], k: int = TOP_K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (rank, key, score) of the k best items for one query: a partial top-k in every task, merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = items.select(key, rounded(dot(F.col(vector), q), PLACES).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), key, "score")


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _rounded(s: np.ndarray) -> np.ndarray:
    """rounded() for scores in an array; np.round would take halves to the even neighbour."""
    with np.errstate(over="ignore", invalid="ignore"):
        many = s * 10.0**PLACES
        whole = np.trunc(many)
        whole += np.copysign(np.abs(many - whole) >= 0.5, many)
    return np.where(np.isinf(many), s, whole / 10.0**PLACES)


def _merged(best_s: np.ndarray, best_k: np.ndarray, s: np.ndarray, keys: np.ndarray, k: int, finite: bool) -> tuple[np.ndarray, np.ndarray]:
    """A row's best scores and keys (k, or all so far) with those of more items; s isn't rounded yet. What can't be among the k best is left
    out by a bound that is lower than theirs by more than rounding makes up; equal scores go by key."""
    n, m = best_s.shape
    slack = 10.0**-PLACES
    passed = np.ones(s.shape, bool) if m < k else ~(s < best_s[:, -1:] - slack)
    if finite and s.shape[1] > k and np.count_nonzero(passed) > 4 * k * n:
        passed &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - slack
    row, col = np.nonzero(passed)
    if not len(row):
        return best_s, best_k
    rows = np.unique(row)
    of = np.concatenate([np.repeat(rows, m), row])
    scores, ids = np.concatenate([best_s[rows].ravel(), _rounded(s[row, col])]), np.concatenate([best_k[rows].ravel(), keys[col]])
    order = np.lexsort((ids, -scores, of))
    of = of[order]
    order = order[np.arange(len(of)) - np.searchsorted(of, of) < k].reshape(len(rows), -1)
    if m < k:  # every row has met every item
        return scores[order], ids[order]
    best_s[rows], best_k[rows] = scores[order], ids[order]
    return best_s, best_k


def _scan(batches: Iterator[pa.RecordBatch], q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Batches (key, vector) to the best scores and keys of the queries in groups: (place of the first query, scores, keys)."""
    share = SCORES // STEP
    best = [(np.zeros((len(q[at : at + share]), 0)), np.zeros((len(q[at : at + share]), 0), np.int64)) for at in range(0, len(q), share)]
    finite = bool(np.isfinite(q).all())
    for batch in batches if len(q) else ():
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            keys, v = part.column(0).to_numpy(), _vectors(part.column(1), q.shape[1])
            sure = finite and bool(np.isfinite(v).all())
            for g, (s, ids) in enumerate(best):
                best[g] = _merged(s, ids, q[g * share : (g + 1) * share] @ v.T, keys, k, sure)
    for g, (s, ids) in enumerate(best):
        yield g * share, s, ids


def _best(items: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, key: str, vector: str) -> DataFrame:
    """Rows (query_id, key, score): of each task the k best items for each query."""
    shared = items.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for at, s, found in _scan(batches, q, k):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + len(s)], s.shape[1])), pa.array(found.ravel()), pa.array(s.ravel())], ["query_id", key, "score"])

    return items.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query_id bigint, {key} bigint, score double")


def _query_blocks(queries: DataFrame, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries(query_id, embedding) in blocks of bounded size."""
    n, dim = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-(n * 8 * ((dim or 1) + 2 * k)) // QUERY_BYTES))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        yield np.array([r.query_id for r in part], np.int64), np.array([r.embedding for r in part], np.float64).reshape(len(part), dim or 0)


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def knn_topk_batch(items: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, key, score). queries(query_id, embedding) go out in blocks of bounded size; every task multiplies its
    items by a block and keeps k for each query, so a query's candidates are k times the tasks, never the table."""
    out = None
    for ids, vectors in _query_blocks(queries, k):
        found = _best(items, ids, vectors, k, key, vector)
        out = found if out is None else out.unionByName(found)
    return _ranked(out, k, key)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a bounded number of products at a time."""
    size, step = (centres**2).sum(1)[None, :], max(1, SCORES // len(centres))
    return np.concatenate([np.argmin(size - 2 * v[at : at + step] @ centres.T, axis=1) for at in range(0, len(v), step)] or [np.zeros(0, np.int64)])


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most `cells` groups of the sample rows."""
    rng = np.random.default_rng(0)
    centres = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)
        for c in range(len(centres)):
            own = sample[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def build_cells(items: DataFrame, path: str, cells: int | None = None, key: str = "vec_id", vector: str = "embedding") -> None:
    """An index for exact search that reads part of its files: items dealt to the nearest of some centres, a folder for each cell under
    path/items; path/cells has each cell's centre, radius and number of items. The centres come from at most CELL_SAMPLE items by hash; every
    item is indexed, items without a vector aren't. By default there are about as many cells as their items' square root, MAX_CELLS at most."""
    rows = items.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<float>").alias(vector))
    n = rows.count()
    if not n:
        raise ValueError("no items to index")
    share = max(1, n // CELL_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).orderBy(F.xxhash64(key)).limit(CELL_SAMPLE).collect() or rows.limit(1).collect()
    centres = _centroids(np.array([r[vector] for r in sample], np.float64), cells or min(MAX_CELLS, max(1, round(n**0.5))))
    shared = items.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            v = _vectors(batch.column(1), c.shape[1])
            near = _nearest(v, c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(np.linalg.norm(v - c[near], axis=1))], [key, vector, "cell", "_far"])

    placed = rows.mapInArrow(place, f"{key} bigint, {vector} array<float>, cell int, _far double")
    # a cell may hold any share of the items: several tasks write a large one
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(CELL_FILES))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    facts = items.sparkSession.read.parquet(f"{path}/items").groupBy("cell").agg(F.max("_far").alias("radius"), F.count("*").alias("n"))
    centre = items.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    facts.join(centre, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def knn_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """knn_topk_batch over an index of build_cells, with the same rows. A first pass reads the cells that look best for each query until they hold
    k items, which bounds the k-th score from below; the second reads those others in which some query's bound (its product with the
    centre, and the radius times its length) reaches that far. All other cells are never opened."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    number = np.array([r.cell for r in cells])
    centre, radius, sizes = np.array([r.centre for r in cells]), np.array([r.radius for r in cells]), np.array([r.n for r in cells])
    items = spark.read.parquet(f"{path}/items")
    out = None
    for ids, q in _query_blocks(queries, k):
        if not len(ids):
            continue
        parts = range(0, len(ids), max(1, SCORES // len(number)))  # queries by cells, a bounded number of products at a time
        looked = np.zeros(len(number), bool)
        for p in parts:
            order = np.argsort(-(q[p : p + parts.step] @ centre.T), axis=1)
            held = np.cumsum(sizes[order], axis=1)
            looked[order[held - sizes[order] < k]] = True
        read = number[looked]
        found = written(_best(items.where(F.col("cell").isin(read.tolist())), ids, q, k, key, vector), "knn-cells")
        least = np.full(len(ids), -np.inf)
        at = {int(x): i for i, x in enumerate(ids)}
        for row in _ranked(found, k, key).where(F.col("rank") == k).collect():  # one a query of the block
            least[at[row.query_id]] = row.score
        reached = np.zeros(len(number), bool)
        for p in parts:
            part = q[p : p + parts.step]
            reach = part @ centre.T + np.linalg.norm(part, axis=1)[:, None] * radius[None, :] + 2 * 10.0**-PLACES
            reached |= (reach >= least[p : p + parts.step, None]).any(axis=0)
        more = number[reached & ~looked]
        if len(more):
            found = found.unionByName(_best(items.where(F.col("cell").isin(more.tolist())), ids, q, k, key, vector))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {key} bigint, score double")
    return _ranked(out, k, key)


def hit_lookup(hits: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return hits.join(items, key)


def rerank_topn(hits: DataFrame, n: int = TOP_N) -> DataFrame:
    """hits(query_id, rank, score, rerank_score, ...) to the n best by rerank_score, equal ones in their old order; the old rank and score stay as faiss_*."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "faiss_rank")
    out = hits.withColumnRenamed("rank", "faiss_rank").withColumnRenamed("score", "faiss_score")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def topn_no_rerank(hits: DataFrame, n: int = TOP_N) -> DataFrame:
    return hits.where(F.col("rank") <= n)


def _four(c: Column) -> Column:
    return F.format_string("%.4f", F.coalesce(c, F.lit(0.0)))


def _text(fallback: bool) -> Column:
    q, a = strip(F.coalesce("question", F.lit(""))), strip(F.coalesce("answer", F.lit("")))
    block = F.concat(F.lit("问题："), q, F.lit("\n答案："), a)
    return F.when((q == "") & (a == ""), strip(F.coalesce("index_text", F.lit("")))).otherwise(block) if fallback else block


def _joined(results: DataFrame, block: Column, between: str, most: int, notice: str) -> DataFrame:
    """Blocks of a query in rank order, cut at `most` characters. A query has as many rows as it keeps results."""
    parts = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("p"))
    parts = parts.select("query_id", F.array_join(F.transform("p", lambda x: x["b"]), between).alias("c"))
    return parts.select("query_id", F.when(F.length("c") > most, F.concat(F.substring("c", 1, most), F.lit(notice))).otherwise(F.col("c")).alias("context"))


def build_context(results: DataFrame, most: int = 6000) -> DataFrame:
    """results(query_id, rank, question, answer, index_text, faiss_score, rerank_score) to rows (query_id, context)."""
    rank = F.col("rank").cast("string")
    head = F.when(F.col("rerank_score").isNotNull(), F.concat(F.lit("[资料"), rank, F.lit(" | FAISS相似度 "), _four(F.col("faiss_score")), F.lit(" | Rerank分数 "), _four(F.col("rerank_score")), F.lit("]")))
    head = head.otherwise(F.concat(F.lit("[资料"), rank, F.lit(" | 相似度 "), _four(F.col("faiss_score")), F.lit("]")))
    return _joined(results, F.concat(head, F.lit("\n"), _text(True)), "\n\n", most, CUT_NOTICE)


def build_context_sources(results: DataFrame, most: int = 6000) -> DataFrame:
    """Also with faiss_rank, category, source_title and source_url."""
    rank = F.col("rank").cast("string")
    head = F.when(
        F.col("rerank_score").isNotNull(),
        F.concat(F.lit("[资料"), rank, F.lit(" | FAISS排名 "), F.coalesce(F.col("faiss_rank").cast("string"), F.lit("?")), F.lit(" | FAISS分数 "), _four(F.col("faiss_score")), F.lit(" | Rerank分数 "), _four(F.col("rerank_score")), F.lit("]")),
    ).otherwise(F.concat(F.lit("[资料"), rank, F.lit(" | 相似度 "), _four(F.col("faiss_score")), F.lit("]")))
    body = F.concat_ws("\n", _text(True), labelled("类别：", F.col("category")), labelled("来源标题：", F.col("source_title")), labelled("来源链接：", F.col("source_url")))
    return _joined(results, F.concat(head, F.lit("\n"), body), "\n\n", most, CUT_NOTICE)


def build_context_search(results: DataFrame, most: int = 5000) -> DataFrame:
    """Labelled lines; a missing rerank score shows as 0.0000."""
    block = F.concat(
        F.lit("[资料"), F.col("rank").cast("string"), F.lit("]\nFAISS 排名："), F.coalesce(F.col("faiss_rank").cast("string"), F.lit("None")), F.lit("\nFAISS 分数："), _four(F.col("faiss_score")),
        F.lit("\nRerank 分数："), _four(F.col("rerank_score")), F.lit("\n"), _text(False), F.lit("\n"),
    )
    return _joined(results, block, "\n", most, CUT_NOTICE_SEARCH)


def chat_messages(question: Column, context: Column) -> Column:
    user = F.concat(F.lit(USER_HEAD), context, F.lit(USER_MIDDLE), question, F.lit(USER_TAIL))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def answer_with_sources(results: DataFrame, answers: DataFrame) -> DataFrame:
    """answers(query_id, answer) with a Markdown list of the results under it."""
    q = strip(F.coalesce("question", F.lit("")))
    q = F.when(F.length(q) > 80, F.concat(F.substring(q, 1, 80), F.lit("..."))).otherwise(q)
    line = F.concat(F.lit("- ["), F.col("rank").cast("string"), F.lit("] "), q, F.lit("\n  - FAISS: "), _four(F.col("faiss_score")), F.when(F.col("rerank_score").isNotNull(), F.concat(F.lit(", Rerank: "), _four(F.col("rerank_score")))).otherwise(F.lit("")))
    parts = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("p"))
    text = F.concat("answer", F.lit("\n\n---\n\n**参考资料 Top "), F.size("p").cast("string"), F.lit("：**\n"), F.array_join(F.transform("p", lambda x: x["l"]), "\n"))
    return parts.join(answers, "query_id").select("query_id", text.alias("reply"))

"""Operator 12, ranked lexical search: document-at-a-time over a sharded index of compressed postings.

Index: each task turns its documents into shards of about SHARD_BYTES of text (one document at least), one row each: doc_ids in ascending
order, their lengths, the vocabulary, and per term the gaps between document places and the counts, as variable-length bytes. A shard is
built and read on its own, nothing is shuffled, and any number of searches can use the written index.

Search: the queries' terms (in blocks of at most BLOCK_TERMS) are broadcast. One pass sums their document frequencies over the shards'
vocabularies; the second walks each shard. For every query the posting lists are merged by a heap, a document at a time; a heap of the k best
(score, then smaller doc_id) lives on from shard to shard of a task. Lists of small weight whose highest scores together can't lift a
document over the k-th best leave the merge and are only looked up for documents that the others bring up, so the result is exact. The tasks'
lists are then merged, first in groups, then all.

Null or empty texts have no terms and are never hits. Queries without terms have no rows. Rows with the same item_id are one query (a null
item_id too). Each row of documents is one document: repeated rows each have a rank; a null doc_id stands before all others among equal
scores. Other columns are ignored; empty tables on either side give no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm import kernel, terms
from kbforge.llm.scratch import written

#: Bytes of text in a shard; query terms that one pass takes; groups of tasks whose results are merged first.
SHARD_BYTES, BLOCK_TERMS, GROUPS = 4 << 20, 200_000, 64
TOP = 50
#: Contributions stand below this many bits, places in a shard above.
_BITS = 40

INDEX = "doc_ids array<bigint>, lengths binary, n_docs bigint, n_terms bigint, vocabulary array<binary>, df binary, ends binary, postings binary"
_INDEX = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("vocabulary", pa.list_(pa.binary())), ("df", pa.binary()),
    ("ends", pa.binary()), ("postings", pa.binary()),
])


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits, the last of each without the high bit; and how many bytes each takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1) << np.uint64(7 * k)
    out = np.zeros(int(sizes.sum()), np.uint8)
    last = np.cumsum(sizes) - 1
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = sizes > k
        out[last[some] - k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)) | np.uint64(128 if k else 0)
    return out, sizes


def unpacked(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    out = (raw[last] & 127).astype(np.int64)
    sizes = np.diff(last, prepend=-1)
    for k in range(1, int(sizes.max()) if len(sizes) else 0):
        some = sizes > k
        out[some] |= (raw[last[some] - k] & 127).astype(np.int64) << (7 * k)
    return out


def _shard(doc_ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """One row of the index. Documents without terms aren't part of it."""
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0))
    column = pa.array([texts[i] for i in order], pa.large_string())
    lengths, words = [], []
    for _, _, _, _, t in terms.slices(column):
        lengths.append(np.diff(t.first))
        words.append(t.values)
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
    keep = np.flatnonzero(lengths)
    place = np.repeat(np.arange(len(keep)), lengths[keep])
    n = max(len(keep), 1)
    keys, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + place, return_counts=True)
    term, doc = keys // n, keys % n
    df = np.bincount(term, minlength=len(coded.dictionary))
    first = np.ones(len(term), bool)
    first[1:] = term[1:] != term[:-1]
    gaps = np.where(first, doc, np.diff(doc, prepend=0))
    both = np.stack([gaps, tf], 1).ravel()
    raw, sizes = packed(both)
    ends = np.cumsum(sizes)[2 * np.cumsum(df) - 1] if len(df) else np.zeros(0, np.int64)
    row = {
        "doc_ids": [doc_ids[order[i]] for i in keep.tolist()], "lengths": lengths[keep].astype(np.int64).tobytes(), "n_docs": len(keep), "n_terms": int(lengths.sum()),
        "vocabulary": coded.dictionary.cast(pa.binary()).to_pylist(), "df": df.astype(np.int64).tobytes(), "ends": ends.astype(np.int64).tobytes(), "postings": raw.tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], _INDEX)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, a row a shard. Write it before it is searched."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for a, b in kernel.pieces(batch.column(1), min(1 << 16, shard_bytes)):
                part = batch.slice(a, b - a)
                nbytes = part.column(1).nbytes
                if texts and size + nbytes > shard_bytes:
                    yield _shard(ids, texts)
                    ids, texts, size = [], [], 0
                    kernel.release()
                ids += part.column(0).to_pylist()
                texts += part.column(1).to_pylist()
                size += nbytes
        if texts:
            yield _shard(ids, texts)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(build, INDEX)


class Shard:
    """The posting lists of some terms of one shard, as sorted integers: place << _BITS | contribution."""

    def __init__(self, row: dict, wanted: pa.Array, weights: np.ndarray, n_all: int, l_all: int):
        self.doc_ids = row["doc_ids"]
        lengths = np.frombuffer(row["lengths"], np.int64)
        ends = np.frombuffer(row["ends"], np.int64)
        raw = np.frombuffer(row["postings"], np.uint8)
        m = 50 + 50 * lengths * n_all // l_all
        at = pc.index_in(wanted, value_set=row["vocabulary"])
        self.lists: dict[int, list[int]] = {}
        self.best: dict[int, int] = {}
        for k in np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)).tolist():
            w = int(weights[k])
            if w <= 0:
                continue
            t = at[k].as_py()
            pairs = unpacked(raw[ends[t - 1] if t else 0 : ends[t]])
            places, tf = np.cumsum(pairs[::2]), pairs[1::2]
            scores = w * (1_000_000_000 * tf // (1000 * tf + 20 * m[places]))
            some = scores > 0
            if some.any():
                self.lists[k] = (places[some] << _BITS | scores[some]).tolist()
                self.best[k] = int(scores.max())

    def search(self, query: list[int], best: list[tuple[int, float, int | None]], top: int) -> None:
        """Offers the documents of this shard to the heap `best` of (score, minus doc_id, doc_id)."""
        own = sorted((k for k in query if k in self.lists), key=self.best.__getitem__)
        if not own:
            return
        lists, doc_ids, mask = self.lists, self.doc_ids, (1 << _BITS) - 1
        least = best[0][0] if len(best) == top else 1
        # lists of small scores: together below the least score that still counts
        ceilings, total = [], 0
        for k in own:
            total += self.best[k]
            ceilings.append(total)
        if total < least:
            return
        aside = 0
        while ceilings[aside] < least and aside + 1 < len(own):
            aside += 1
        rest = [(lists[own[j]], ceilings[j]) for j in range(aside - 1, -1, -1)]
        above = ceilings[aside - 1] if aside else 0
        cursors = [lists[k] for k in own[aside:]]
        merge = [(x[0], j, 0) for j, x in enumerate(cursors)]
        heapq.heapify(merge)
        while merge:
            head = merge[0][0]
            place, score = head >> _BITS, 0
            while merge and merge[0][0] >> _BITS == place:
                posting, j, i = merge[0]
                score += posting & mask
                if i + 1 < len(cursors[j]):
                    heapq.heapreplace(merge, (cursors[j][i + 1], j, i + 1))
                else:
                    heapq.heappop(merge)
            if score + above < least:
                continue
            for other, ceiling in rest:
                if score + ceiling < least:
                    break
                i = bisect_left(other, place << _BITS)
                if i < len(other) and other[i] >> _BITS == place:
                    score += other[i] & mask
            if score < least:
                continue
            doc_id = doc_ids[place]
            entry = (score, math.inf if doc_id is None else -doc_id, doc_id)
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry[:2] > best[0][:2]:
                heapq.heapreplace(best, entry)
            if len(best) == top:
                least = best[0][0]


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[dict[int | None, set[bytes]]]:
    """Queries as item_id to terms, in blocks of about `most` terms at most (one query at least); rows with an item_id stand together."""
    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).orderBy("item_id")
    block: dict[int | None, set[bytes]] = {}
    size, name = 0, object()
    for item, t in rows.toLocalIterator():
        if item != name and size >= most:
            yield block
            block, size = {}, 0
        name = item
        own = block.setdefault(item, set())
        before = len(own)
        own.update(terms.of_text(t))
        size += len(own) - before
    if block:
        yield block


def _search_block(built: DataFrame, queries: dict[int | None, set[bytes]], totals: tuple[int, int], top: int) -> DataFrame:
    spark = built.sparkSession
    vocabulary = sorted(set().union(*queries.values()))
    n_all, l_all = totals
    words = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(words.value, pa.binary())
        sums = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                at = pc.index_in(wanted, value_set=batch.column(0)[r].values)
                found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                sums[found] += np.frombuffer(batch.column(1)[r].as_py(), np.int64)[at.take(pa.array(found)).to_numpy(zero_copy_only=False)]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["term", "df"])

    df = built.select("vocabulary", "df").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in df.collect():  # as many rows as the block has terms at most
        weights[term] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1)))
    number = {w: k for k, w in enumerate(vocabulary)}
    asked = spark.sparkContext.broadcast(([(item, [number[w] for w in own]) for item, own in queries.items()], weights))

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = asked.value
        wanted = pa.array(words.value, pa.binary())
        best: list[list] = [[] for _ in own]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("doc_ids", "lengths", "vocabulary", "ends", "postings")}
                shard = Shard({c: v.values if c == "vocabulary" else v.as_py() for c, v in row.items()}, wanted, w, n_all, l_all)
                for (_, query), heap in zip(own, best):
                    shard.search(query, heap, top)
        rows = [(item, doc_id, score) for (item, _), heap in zip(own, best) for score, _, doc_id in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], ["item_id", "doc_id", "score"])

    found = built.select("doc_ids", "lengths", "vocabulary", "ends", "postings").mapInArrow(best_of_task, "item_id bigint, doc_id bigint, score bigint")
    return found.withColumn("_group", F.spark_partition_id() % GROUPS)


def search(built: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the `top` best documents of a written index for each query."""
    totals = built.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    none = built.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not totals[0]:
        return none
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    out = none
    for queries in _blocks(items, item_id, text, block_terms):
        found = _search_block(built, queries, (totals[0], totals[1]), top)
        some = found.withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "_group").orderBy(*order))).where(F.col("_r") <= top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(written(index(docs), "lexical-index"), benchmark)


#: DuckDB SQL: every posting of every item's terms.
ORACLE_SQL = (
    f"WITH w AS (SELECT row_number() OVER () AS r, doc_id, {terms.sql_terms('text')} AS w FROM documents), "
    "d AS (SELECT r, doc_id, len(w) AS n, w FROM w WHERE len(w) > 0), "
    "a AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l_all FROM d), "
    "p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL), "
    f"q AS (SELECT DISTINCT item_id, unnest({terms.sql_terms('text')}) AS t FROM benchmark), "
    "f AS (SELECT t, floor(1000 * ln((2 * n_all + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), a), "
    "m AS (SELECT r, doc_id, 50 + (50 * n * n_all) // l_all AS m FROM d, a), "
    "s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id), "
    f"k AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) "
    f"SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"
)

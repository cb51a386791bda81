"""Operator 2, lexical retrieval packing: documents that share rare tokens fill a training window together.

Every document is its token ids and an end id. Whole windows are cut off its front; what is left waits in a shard with an
inverted BM25 index over the shard's left-overs. Document frequencies and the mean length cover the whole corpus.
Shards are dealt by content: each left-over draws SKETCH of its tokens by weighted min-hashing (the weight is the token's inverse
document frequency), left-overs are sorted by what they drew, and SHARD of them in a row are a shard. So left-overs that share
rare tokens meet in one shard with a chance that grows with what they share, and a key drawn by very many is cut into several shards.
Each seed, in order of doc_id, asks its shard's index for its neighbours by all its tokens; unused ones fill the seed's window
greedily, best first and down to the last that scores above 0, the last one cut where the window is full, its rest staying in the
pool. Where no neighbour is left, the next unused left-over in order follows. Only the last window of a shard can be short.

Null or empty text: the end id alone. Repeated rows are packed as often as they stand; ties in score go to the smaller
(doc_id, start). A null doc_id comes first. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm import fast_ids, kernel
from kbforge.llm.scratch import written

WINDOW, END_ID = 1024, 0
#: Left-overs of a shard; tokens that each draws as its key; BM25 parameters.
SHARD, SKETCH, K1, B = 2048, 4, 1.2, 0.75
#: Neighbours of a seed that are sorted at first.
BEST = 32

_CUT = "kind int, doc_id bigint, start bigint, length bigint, doc_tokens bigint, crc bigint, ids binary, sequence_id bigint"
_NAMES = ["kind", "doc_id", "start", "length", "doc_tokens", "crc", "ids", "sequence_id"]
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(tokenizer_path: str, pattern: str, window: int, with_ids: bool):
    """Rows (doc_id, text) to rows of kind 0: a whole window; 1: a left-over with its ids; 2: the partition's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.keep_freed()
        reader = fast_ids.reader(tokenizer_path, pattern)
        frequency = np.zeros(reader.tokenizer.get_vocab_size() + 1, np.int64)
        place = np.zeros(len(frequency), np.int64)
        n_docs = n_tokens = 0
        base, n_whole = -(TaskContext.get().partitionId() + 1) << 32, 0
        end = np.array([END_ID], reader.dtype)
        for batch in batches:
            for lo, hi, flat, ends in reader.slices(batch.column(1)):
                out: list[tuple] = []
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    ids = np.concatenate([flat[a:b], end])
                    order = np.arange(len(ids))
                    place[ids] = order
                    frequency[ids[place[ids] == order]] += 1  # each token once
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
                    whole = len(ids) // window * window
                    for at in range(0, whole, window):
                        piece = ids[at : at + window]
                        out.append((0, doc, at, window, len(ids), crc_of(piece), piece.tobytes() if with_ids else None, base + n_whole))
                        n_whole += 1
                    if whole < len(ids):
                        out.append((1, doc, whole, len(ids) - whole, len(ids), None, ids[whole:].tobytes(), None))
                yield _rows(out)
        if n_docs:
            yield _rows([(2, None, None, n_docs, n_tokens, None, frequency.astype("<i8").tobytes(), None)])
        kernel.release()

    return run


_CUT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CUT_TYPES)], _NAMES)


def drawn(docs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """[len(docs), SKETCH] tokens drawn from each by weighted min-hashing: equal sets draw alike, and two sets draw the same with the chance of their weighted overlap."""
    flat = np.concatenate(docs).astype(np.int64)
    begin = np.cumsum([0, *(len(d) for d in docs[:-1])])
    out = np.empty((len(docs), SKETCH), np.int32)
    for k in range(SKETCH):
        u = (kernel.mix(np.arange(len(idf), dtype=np.uint64), 7919 + k) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        # rank of each token by its exponential variable of rate idf: the least one is drawn
        order = np.argsort(-np.log(u + 2.0**-54) / np.maximum(idf, 1e-9), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        out[:, k] = order[np.minimum.reduceat(rank[flat], begin)]
    return out


def _keyed(idf_shared, dtype: np.dtype):
    """Left-overs with what they drew as columns k0, k1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = drawn([np.frombuffer(x, dtype) for x in batch.column("ids").to_pylist()], idf_shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k) for k in keys.T.copy())], [*batch.schema.names, *(f"k{i}" for i in range(SKETCH))])

    return run


class Index:
    """BM25 over the left-overs of a shard; terms are token ids. Terms that one in DENSE left-overs holds are rows of a matrix, the others postings."""

    DENSE = 12

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(docs)
        length = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        both = np.sort(np.repeat(np.arange(self.n), length) * len(idf) + flat)
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(both))).astype(np.float64)
        doc, term = np.divmod(both[at], len(idf))
        self.queries = np.split(term, np.searchsorted(doc, np.arange(1, self.n)))
        norm = K1 * (1 - B + B * length[doc] / max(mean_length, 1.0))
        weight = (idf[term] * count * (K1 + 1) / (count + norm)).astype(np.float32)
        df = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(df * self.DENSE >= max(self.n, 1))
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        dense = self.row[term] >= 0
        self.matrix[self.row[term[dense]], doc[dense]] = weight[dense]
        order = np.argsort(term[~dense], kind="stable")
        self.doc, self.weight, term = doc[~dense][order], weight[~dense][order], term[~dense][order]
        self.at = np.searchsorted(term, np.arange(len(idf) + 1))
        self.live = np.arange(self.n)  # the left-overs that columns stand for

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every left-over that the index still holds (see live) for all tokens of left-over i."""
        q = self.queries[i]
        row = self.row[q]
        s = self.matrix[row[row >= 0]].sum(0, dtype=np.float32).astype(np.float64)
        q = q[row < 0]
        size = self.at[q + 1] - self.at[q]
        rows = np.repeat(self.at[q] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return s + np.bincount(self.doc[rows], self.weight[rows], len(self.live))

    def keep(self, free: np.ndarray) -> None:
        """Drops left-overs that are used up."""
        stays = free[self.live]
        place = np.cumsum(stays) - 1
        own = stays[self.doc]
        before = np.concatenate([[0], np.cumsum(own)])
        self.at, self.doc, self.weight = before[self.at], place[self.doc[own]], self.weight[own]
        self.matrix, self.live = self.matrix[:, stays], self.live[stays]


def _ranking(s: np.ndarray) -> Iterator[int]:
    """Places of scores above 0, highest first, equal ones in order. Few are asked for as a rule: BEST, with those that tie, are sorted first."""
    best = np.flatnonzero(s > 0)
    if len(best) > 4 * BEST:
        own = s[best]
        least = np.partition(own, len(best) - BEST)[len(best) - BEST]
        first = best[own >= least]
        yield from first[np.argsort(-s[first], kind="stable")].tolist()
        best = best[own < least]
    yield from best[np.argsort(-s[best], kind="stable")].tolist()


def fill(lengths: list[int], index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (left-over, from, length). Every id is placed once; all windows but the last are full."""
    start = [0] * len(lengths)
    left = list(lengths)
    free = np.ones(len(lengths), bool)
    windows: list[list[tuple[int, int, int]]] = []
    cursor = 0
    while True:
        while cursor < len(left) and not left[cursor]:
            cursor += 1
        if cursor == len(left):
            return windows
        seed, room, now = cursor, window, []

        def take(i: int) -> None:
            nonlocal room
            n = min(room, left[i])
            now.append((i, start[i], n))
            start[i], left[i], room = start[i] + n, left[i] - n, room - n
            free[i] = left[i] > 0

        take(seed)
        if room:
            if 4 * free.sum() < 3 * len(index.live):
                index.keep(free)
            s = index.scores(seed)
            s[~free[index.live]] = 0
            for i in _ranking(s):
                if not room:
                    break
                take(int(index.live[i]))
        after = cursor
        while room and after < len(left):
            if left[after]:
                take(after)
            after += 1
        windows.append(now)


def _pack(idf_shared, mean_length: float, dtype: np.dtype, window: int, shard: int, with_ids: bool):
    """Left-overs in order of their keys to pieces, shard by shard."""

    def one(rows: pa.Table, base: int) -> pa.RecordBatch:
        r = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids", "ascending")]).to_pydict()
        ids = [np.frombuffer(x, dtype) for x in r["ids"]]
        out: list[tuple] = []
        for n, parts in enumerate(fill([len(x) for x in ids], Index(ids, idf_shared.value, mean_length), window)):
            offset = 0
            for i, a, m in parts:
                piece = ids[i][a : a + m]
                out.append((r["doc_id"][i], r["start"][i] + a, m, crc_of(piece), r["doc_tokens"][i], base + n, offset, piece.tobytes() if with_ids else None))
                offset += m
        cols = list(zip(*out))
        made = {name: pa.array(c, pa.int64()) for name, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), cols)}
        if with_ids:
            made["ids"] = pa.array(cols[7], pa.binary())
        return pa.RecordBatch.from_pydict(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.keep_freed()
        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(shard - size, batch.num_rows - at)
                held.append(batch.slice(at, n))
                at, size = at + n, size + n
                if size == shard:
                    yield one(pa.Table.from_batches(held), base)
                    base, held, size = base + shard, [], 0
        if held:
            yield one(pa.Table.from_batches(held), base)
        fast_ids.forget()  # no ids are made from here on

    return run


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, window: int = WINDOW, text: str = "text", with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with_ids: and the ids, little-endian, two bytes each where the vocabulary allows."""
    spark = docs.sparkSession
    cut = written(docs.select("doc_id", text).mapInArrow(_cut(tokenizer_path, pattern, window, with_ids), _CUT), "pack-cut")
    # document frequencies of all partitions, added up by token id: at most one row for each id of the vocabulary
    stats = cut.where("kind = 2")
    n_docs, n_tokens = stats.agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    reader = fast_ids.reader(tokenizer_path, pattern)
    frequency = np.zeros(reader.tokenizer.get_vocab_size() + 1)
    summed = stats.select("ids").mapInArrow(_frequencies, "i int, df bigint").groupBy("i").agg(F.sum("df").alias("df")).collect()
    for row in summed:
        frequency[row.i] = row.df
    idf = spark.sparkContext.broadcast(np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)))
    columns = ["doc_id", "start", "length", "doc_tokens", "ids"]
    keys = [f"k{i}" for i in range(SKETCH)]
    left = cut.where("kind = 1").select(*columns).mapInArrow(_keyed(idf, reader.dtype), "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, " + ", ".join(f"{k} int" for k in keys))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # more partitions than shards would only leave more windows short
    parts = max(1, min(parts, -(-n_docs // shard)))
    order = [*keys, "doc_id", "start"]
    ordered = left.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns)
    schema = _PIECE + (", ids binary" if with_ids else "")
    packed = ordered.mapInArrow(_pack(idf, n_tokens / max(n_docs, 1), reader.dtype, window, shard, with_ids), schema)
    whole = cut.where("kind = 0").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"), *(["ids"] if with_ids else []))
    return packed.unionByName(whole)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            one = np.frombuffer(raw, "<i8")
            total = one.copy() if total is None else total + one
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "df"])


def op2(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

"""Operator 1, language-model scoring: a gated recurrent model over words gives the log10 probability of whole documents.

Counts of all training words are exact and cover the corpus. The most frequent ones are the vocabulary of the recurrent
model; any other word is its symbol TAIL times a static share: absolute discounting over the counts of all other training words,
the discounted mass going to unknown words as one event. So the model's events are those of the base: V known tokens and one unknown.
The recurrent weights learn from every training document once: the documents are dealt over ROUNDS rounds by a hash of doc_id;
in a round every partition trains on its share from the same start, and the weights that moved are averaged by the words seen. So the
scores of the network depend on how the input is partitioned, all other columns don't.

Null or empty text: the end token alone. No training documents: every word is unknown, scores stay finite. Repeated rows
are scored alike and count as often as they stand. A null doc_id is neither held out nor trained on. Other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.llm import gru, kernel
from kbforge.llm.scratch import written

#: Words of the recurrent model; words whose counts travel to every task (bounds on what is broadcast).
VOCABULARY, HEAD = 8190, 65_536
#: Rounds of training and averaging, and the step of the first one.
ROUNDS, RATE = 3, 0.3
#: Weights that travel in one row.
CHUNK = 8192
_MERGE_AT = 1 << 20
#: Leading bits of a hash by which the head is looked up.
_LEADING = 18
#: Words whose documents a task scores side by side.
SIDE_BY_SIDE = 2_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes and their counts, added up over the partition."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], np.add.reduceat(c, at)

    for batch in batches:
        for _, _, data, offsets in kernel.slices(batch.column(0)):
            h = kernel.Words(data, offsets).hashes(fold=True)
            if len(h):
                u, c = np.unique(h, return_counts=True)
                held.append((u, c.astype(np.int64)))
                size += len(u)
                if size > _MERGE_AT:
                    held = [merged()]
                    size = len(held[0][0]) if len(held[0][0]) < _MERGE_AT // 2 else size - _MERGE_AT // 2
    if held:
        h, c = merged()
        for at in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000])], ["h", "c"])
    kernel.release()


class Lexicon:
    """Sorted hashes of the head with counts and symbols (0: outside the recurrent vocabulary)."""

    def __init__(self, rows: list[tuple[int, int]], vocabulary: int):
        rank = sorted(rows, key=lambda r: (-r[1], r[0]))
        h = np.array([r[0] for r in rank], np.int64).view(np.uint64)
        c = np.array([r[1] for r in rank], np.int64)
        s = np.where(np.arange(len(rank)) < vocabulary, np.arange(len(rank)) + 2, 0)
        order = np.argsort(h)
        self.hashes, self.counts, self.symbols = h[order], c[order], s[order].astype(np.int64)
        # hashes are spread evenly, so where those with the same leading bits begin is next to the place
        self.begin = np.searchsorted(self.hashes, np.arange(1 << _LEADING, dtype=np.uint64) << np.uint64(64 - _LEADING)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if absent."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        last = len(self.hashes) - 1
        at = np.minimum(self.begin.take((h >> np.uint64(64 - _LEADING)).view(np.int64)), last).astype(np.int64)
        found = self.hashes.take(at)
        late = np.flatnonzero((found < h) & (at < last))
        while len(late):
            at[late] += 1
            found[late] = more = self.hashes.take(at[late])
            late = late[(more < h[late]) & (at[late] < last)]
        return np.where(found == h, at, -1)


def _symbols(lex: Lexicon, column: pa.Array) -> Iterator[tuple[int, int, kernel.Words, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in kernel.slices(column):
        w = kernel.Words(data, offsets)
        h = w.hashes(fold=True)
        at = lex.find(h)
        sym = np.where(at >= 0, lex.symbols[at] if len(lex.symbols) else 0, gru.TAIL)
        yield lo, hi, w, h, at, sym


def _with_ends(sym: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.append(sym[a:b], gru.END) for a, b in zip(first, first[1:])]


def op1(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    trained = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    return score(docs, trained, held, rounds)


def score(docs: DataFrame, trained: Column, held: Column, rounds: int = ROUNDS, text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all docs; the model learns from rows where `trained`."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", F.col(text).alias("text"), trained.alias("trained"), held.alias("held"))
    learn = rows.where("trained").select("doc_id", "text")
    counts = written(learn.select("text").mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")
    # the head's place among the counts comes first, so that tasks don't each send a whole head to the driver
    step = F.floor(F.log2("c") * 16)
    steps = sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True)
    least_step = next((r[0] for r, n in zip(steps, np.cumsum([r[1] for r in steps])) if n >= HEAD), 0)
    head = counts.where(step >= F.lit(least_step)).orderBy(F.desc("c"), "h").limit(HEAD).collect()
    lex = Lexicon([(r.h, r.c) for r in head], VOCABULARY)
    ends = learn.count()
    every = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    types, tokens, ones, twos = (int(x) for x in every)
    n_train, n_types = tokens + ends, types + (1 if ends else 0)
    in_vocabulary = int(lex.counts[lex.symbols > 0].sum())
    tail_types, tail_tokens = types - int((lex.symbols > 0).sum()), tokens - in_vocabulary
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.05
    log_total = float(np.log10(n_train + n_types + 1))

    def static(c: np.ndarray) -> np.ndarray:
        """log10 share in TAIL of a word with count c, 0 for unknown."""
        if not tail_types:
            return np.zeros(len(c))
        return np.log10(np.where(c > 0, c - discount, discount * tail_types) / tail_tokens)

    sym_counts = np.zeros(int(lex.symbols.max(initial=1)) + 1)
    sym_counts[lex.symbols] = lex.counts
    sym_counts[gru.TAIL], sym_counts[gru.END] = tail_tokens, ends
    model = gru.Gru.fresh(sym_counts)
    lexicon = sc.broadcast(lex)
    for round_ in range(rounds):
        share = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == round_).select("text")
        model = _round(share, lexicon, model, sc, RATE / (1 + round_))
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.keep_freed()
        lx, net = lexicon.value, shared.value
        uid = TaskContext.get().partitionId() << 40  # and the number of the row in its partition
        for batch in batches:
            # many documents run side by side, so that few steps run for the longest ones alone; only symbols are held meanwhile
            symbols, cols, tails, begin, words = [], {k: [] for k in ("n", "known", "base", "static")}, [], 0, 0
            for lo, hi, w, h, at, sym in _symbols(lx, batch.column("text")):
                symbols += _with_ends(sym.astype(np.int32), w.first)
                doc, size = w.doc_of_word(), hi - lo
                c = np.where(at >= 0, lx.counts[at] if len(lx.counts) else 0, 0)
                cols["n"].append(np.diff(w.first) + 1)
                cols["known"].append(np.bincount(doc[at >= 0], minlength=size) + (1 if ends else 0))
                cols["base"].append(np.bincount(doc, np.log10(c + 1.0), size) + np.log10(ends + 1.0))
                near = (at >= 0) & (sym == gru.TAIL)
                cols["static"].append(np.bincount(doc[near], static(c[near]), size))
                far = at < 0
                cut = np.searchsorted(np.flatnonzero(far), w.first)
                tails.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[far].view(np.int64))))
                words += len(sym)
                if words < SIDE_BY_SIDE and hi < batch.num_rows:
                    continue
                value = net.score(symbols) / np.log(10)
                c = {k: np.concatenate(v) for k, v in cols.items()}
                part = batch.slice(begin, hi - begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + hi - begin)), part.column("doc_id"), part.column("held"), pa.array(c["n"], pa.int64()), pa.array(c["known"], pa.int64()), pa.array(c["base"]), pa.array(value + c["static"]), pa.concat_arrays(tails)],
                    ["uid", "doc_id", "held", "n_tokens", "known", "base", "value", "far"],
                )
                uid += hi - begin
                symbols, cols, tails, begin, words = [], {k: [] for k in ("n", "known", "base", "static")}, [], hi, 0
        kernel.release()

    scored = rows.select("doc_id", "text", "held").mapInArrow(run, "uid bigint, doc_id bigint, held boolean, n_tokens bigint, known bigint, base double, value double, far array<bigint>")
    scored = written(scored, "lm-scored")
    # words outside the head: their counts come by a join, which sees a word once for thousands of documents, however frequent it is
    least = int(lex.counts.min()) if len(lex.counts) else 0
    far = scored.where(F.size("far") > 0).select("uid", "far").mapInArrow(_inverted, "h bigint, uids array<bigint>")
    far = far.join(counts.where(F.col("c") <= least), "h", "left").select(F.explode("uids").alias("uid"), F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    part = F.when(F.col("c") > 0, F.col("c") - discount).otherwise(discount * max(tail_types, 1)) / max(tail_tokens, 1)
    part = F.log10(part) if tail_types else F.lit(0.0)
    sums = far.groupBy("uid").agg(F.count_if(F.col("c") > 0).alias("far_known"), F.sum(F.log10(F.col("c") + 1)).alias("far_base"), F.sum(part).alias("far_value"))
    out = scored.drop("far").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known") + zero("far_known")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("far_base") - F.col("n_tokens") * log_total).alias("base_score"), (F.col("value") + zero("far_value")).alias("score"),
    )


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, words) of a batch to rows (word, uids), a uid as often as it holds the word."""
    for batch in batches:
        lists = batch.column(1)
        h = lists.flatten().to_numpy()
        uid = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(h, kind="stable")
        h = h[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        uids = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)), pa.int32()), pa.array(uid[order]))
        yield pa.RecordBatch.from_arrays([pa.array(h[at]), uids], ["h", "uids"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, seen, moved) to a mean for each chunk. A weight's mean is over those who moved it."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for chunk, seen, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            moved = np.frombuffer(raw, np.float32).astype(np.float64)
            if chunk not in sums:
                sums[chunk] = (np.zeros(len(moved)), np.zeros(len(moved)))
            sums[chunk][0][:] += moved * seen
            sums[chunk][1][:] += (moved != 0) * seen
    if sums:
        mean = [(s / np.maximum(n, 1)).tobytes() for s, n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(mean, pa.binary())], ["chunk", "mean"])


def _round(share: DataFrame, lexicon, model: gru.Gru, sc, rate: float) -> gru.Gru:
    """Every partition trains on its documents from the same weights; the results are averaged by the words they have seen."""
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.keep_freed()
        learner = shared.value.trainer(rate)
        for batch in batches:
            for _, _, w, _, _, sym in _symbols(lexicon.value, batch.column("text")):
                learner.feed(_with_ends(sym, w.first))
        learner.finish()
        kernel.release()
        if learner.seen:
            moved = learner.model.flat() - shared.value.flat()
            parts = [moved[at : at + CHUNK].tobytes() for at in range(0, len(moved), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([learner.seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["chunk", "seen", "moved"])

    # chunks are alike in size, and a task adds up what comes for its chunks row by row
    moved = share.mapInArrow(run, "chunk int, seen bigint, moved binary").repartition("chunk").mapInArrow(_averaged, "chunk int, mean binary")
    flat = model.flat().astype(np.float64)
    for row in moved.collect():  # the model, once
        mean = np.frombuffer(row.mean, np.float64)
        flat[row.chunk * CHUNK : row.chunk * CHUNK + len(mean)] += mean
    return model.with_flat(flat)

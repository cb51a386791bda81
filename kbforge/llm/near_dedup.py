"""Operator 6, near-duplicates by HyperMinHash sketches.

A document's set holds the hashes of its distinct k-word shingles. Each hash falls into one of M buckets; a bucket keeps
its least value as a 16-bit register: leading-zero count and MANTISSA bits after the leading one. Empty registers borrow
from full ones along fixed random orders, so that small sets band as well. Bands of registers make the candidate keys;
small groups of one key are compared pair by pair, in larger ones each document is compared with the key's first one
only, never all with all. Candidates pass the size bound, the collision-corrected estimate from the registers, and are then
confirmed on the full sets. Documents with the same set are one class throughout.

After the first pass, keys of large groups that still hold different components are gone through again: first with the
document that shares the most keys with others in front (the original of a group of edited copies), then in random orders
by chunks, in which each document proposes the ones of other components that its registers put nearest, until a round confirms
nothing new. These rounds only save work: documents of keys that are still mixed then are joined exactly. Each lists the rarest of its
shingles, as many as two sets of the wanted similarity can't both miss (prefix filter), and under each such shingle every pair of
different components is tested, block by block, that its places in the two lists (what comes before isn't shared) and the registers,
by MARGIN standard errors, don't rule out.

Null text or text without words: set size 0, a component of its own. Repeated rows of one doc_id count as one document in the
links and each give a row. A doc_id that stands with several texts is as many documents in the search, whose components are one. A null
doc_id is linked with nothing; its component is null.
Ties: the smallest doc_id is kept. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.llm import graph, kernel, skew
from kbforge.llm.scratch import written

M, MANTISSA = 128, 10
BANDS, ROWS = 32, 4
#: Groups of a key up to this size are compared pair by pair.
SMALL = 5
#: Rows of a mixed key whose registers are compared with one another at a time, best partners that a row then proposes, and rounds.
CHUNK, BEST, ROUNDS = 256, 4, 3
#: Rows of a shingle in one block on average, when all blocks are compared with one another; buckets of the shingle counts.
BLOCK, BUCKETS = 2048, 1 << 20
#: Ids of candidates that are broadcast at most (a few dozen MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Standard errors by which an estimate may fall short of the threshold.
MARGIN = 5.0

_rng = np.random.default_rng(1729)
_BORROW = np.stack([np.concatenate([[i], _rng.permutation(np.delete(np.arange(M), i))]) for i in range(M)]).astype(np.int16)
_SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary, keys array<bigint>"
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice; fewer words than k are one shingle."""
    w = kernel.Words(data, offsets)
    h = w.hashes(fold=True)
    g = kernel.windows(h, k)
    for a, b in zip(w.first, w.first[1:]):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield np.array([kernel.whole(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """M registers of 16 bits; 0xFFFF where no shingle fell."""
    out = np.full(M, 0xFFFF, np.uint16)
    if not len(shingles):
        return out
    bucket = (shingles & np.uint64(M - 1)).astype(np.int64)
    value = kernel.mix(shingles, 0xA24BAED4963EE407)
    least = np.full(M, _EMPTY)
    np.minimum.at(least, bucket, value)
    full = least != _EMPTY
    v = np.maximum(least[full], np.uint64(1))
    zeros = 63 - _log2(v)
    shifted = (v << zeros.astype(np.uint64)) << np.uint64(1)  # the leading one falls out
    out[full] = (np.minimum(zeros, 62).astype(np.uint16) << np.uint16(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return out


def _log2(v: np.ndarray) -> np.ndarray:
    """Place of the highest one bit."""
    high, low = (v >> np.uint64(32)).astype(np.float64), (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 31, np.frexp(low)[1] - 1).astype(np.int64)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; none for an empty set."""
    full = regs != 0xFFFF
    if not full.any():
        return np.zeros(0, np.int64)
    if not full.all():
        lack = np.flatnonzero(~full)
        order = _BORROW[lack]
        regs = regs.copy()
        regs[lack] = regs[order[np.arange(len(lack)), full[order].argmax(1)]]
    key = np.arange(BANDS, dtype=np.uint64)
    for column in regs.reshape(BANDS, ROWS).T:
        key = kernel.mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register pairs [n, M], less the collisions expected by chance, and their standard errors."""
    full_a, full_b = a != 0xFFFF, b != 0xFFFF
    used = (full_a | full_b).sum(1)
    same = ((a == b) & full_a).sum(1)
    chance = np.zeros(len(a))
    per_a, per_b = np.maximum(n_a / M, 1e-9)[:, None], np.maximum(n_b / M, 1e-9)[:, None]
    i = np.arange(1, 40)[None, :]
    # the least of n uniform values has i - 1 leading zeros
    p_a = np.exp(-per_a * 0.5**i) - np.exp(-per_a * 0.5 ** (i - 1))
    p_b = np.exp(-per_b * 0.5**i) - np.exp(-per_b * 0.5 ** (i - 1))
    chance = (p_a * p_b).sum(1) / 2**MANTISSA
    j = np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0.0, 1.0)
    return j, np.sqrt(np.maximum(j * (1 - j), 0.16 / 4) / np.maximum(used, 1))


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.slices(batch.column(1)):
                n, s1, s2, sketch, keys = [], [], [], [], []
                for s in shingle_sets(data, offsets, k):
                    regs = registers(s)
                    n.append(len(s))
                    s1.append(int(np.bitwise_xor.reduce(kernel.mix(s, 11))) if len(s) else 0)
                    s2.append(int(np.add.reduce(kernel.mix(s, 13))) if len(s) else 0)
                    sketch.append(regs.tobytes())
                    keys.append(band_keys(regs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "keys"],
                )
        kernel.release()

    return run


def _neighbours(across: bool):
    """Sorted rows (key, rep, n, component) to rows of three kinds. 0: pairs (a, b). 1: rows (rep, rep, key) at the ends of a
    partition, whose groups may go on next door. 2: rows (rep, n, key, rows of the key at hand) of groups of which not every pair was looked at."""

    def made(a: np.ndarray, b: np.ndarray, key: np.ndarray | None, kind: int, beside: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000], b[at : at + 50_000]
            z, w = (pa.nulls(len(x), pa.int64()) if c is None else pa.array(c[at : at + 50_000], pa.int64()) for c in (key, beside))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), z, pa.array(np.full(len(x), kind, np.int32)), w], ["a", "b", "key", "kind", "beside"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None  # (key, rep, n, component) of the last rows, the group's first row in front
        mark: list[tuple[int, int]] = []
        last: tuple[int, int] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "n_shingles", "component")]
            if not len(cols[0]):
                continue
            if keep is None:
                mark.append((int(cols[0][0]), int(cols[1][0])))
                old = 0
            else:
                old = len(keep[0])
                cols = [np.concatenate([x, y]) for x, y in zip(keep, cols)]
            key, rep, n, comp = cols
            total = len(key)
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(fresh, np.arange(total), 0))
            group = np.cumsum(fresh) - 1
            size = np.bincount(group)
            small = size <= SMALL
            small[-1] = small[0] = False  # these may go on in other batches or partitions
            left, right = [first], [np.arange(total)]
            for lag in range(1, SMALL):
                i = np.flatnonzero(small[group[: total - lag]]) if total > lag else np.zeros(0, np.int64)
                left.append(i)
                right.append(i + lag)
            i, j = np.concatenate(left), np.concatenate(right)
            ok = (key[i] == key[j]) & (i != j) & (j >= old) & (rep[i] != rep[j])
            ok &= 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
            if across:
                ok &= comp[i] != comp[j]
            i, j = i[ok], j[ok]
            if len(i):
                ab = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])]), axis=1)
                yield from made(ab[0], ab[1], None, 0)
            if not across:
                big = np.flatnonzero(~small[group])
                big = big[big >= old]
                yield from made(rep[big], n[big], key[big], 2, size[group[big]])
            tail = np.unique([first[-1], total - 1])
            keep = [x[tail] for x in cols]
            last = (int(key[-1]), int(rep[first[-1]]))
        if last is not None:
            mark.append(last)
            ends = np.array(mark, np.int64)
            yield from made(ends[:, 1], ends[:, 1], ends[:, 0], 1)
        kernel.release()

    return run


def _candidates(rows: DataFrame, label: str, order: Column, across: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) from rows (key, rep, n_shingles, component), and the rows (key, rep, n_shingles, beside) of groups that need another look. Keys are dealt by range over (key, order), so a hot key spreads over tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("ord", order).repartitionByRange(parts, "key", "ord").sortWithinPartitions("key", "ord")
    found = written(ordered.select("key", "rep", "n_shingles", "component").mapInArrow(_neighbours(across), "a bigint, b bigint, key bigint, kind int, beside bigint"), label)
    # a group cut by a partition's end: the first rows of its parts are linked to the least of them
    ends = found.where("kind = 1").select("key", F.col("a").alias("rep")).distinct()
    least = ends.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1")
    cut = ends.join(least, "key").select("a", F.col("rep").alias("b"))
    pairs = found.where("kind = 0").select("a", "b").unionByName(cut).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, found.where("kind = 2").select("key", F.col("a").alias("rep"), F.col("b").alias("n_shingles"), "beside")


def _nearest(threshold: float):
    """Sorted rows (key, rep, component, sketch) to pairs (a, b): within chunks of a key, what each row's registers put nearest in other components."""

    def chunk(rep: np.ndarray, comp: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = (sketch != 0xFFFF).astype(np.float32)
        empty = (1 - full) @ (1 - full).T
        same = (sketch[:, None, :] == sketch[None, :, :]).sum(2) - empty
        j = same / np.maximum(M - empty, 1)
        j[(comp[:, None] == comp[None, :]) | (j < threshold)] = 0
        top = np.argsort(-j, axis=1, kind="stable")[:, :BEST]
        i = np.repeat(np.arange(len(rep)), top.shape[1])
        k = top.ravel()
        ok = j[i, k] > 0
        return rep[i[ok]], rep[k[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rep, comp = (batch.column(c).to_numpy() for c in ("key", "rep", "component"))
            if not len(key):
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, M)
            cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            found = []
            for x, y in zip(cut, cut[1:]):
                for at in range(x, y, CHUNK):
                    to = min(at + CHUNK, y)
                    if to - at > 1 and (comp[at:to] != comp[at]).any():
                        found.append(chunk(rep[at:to], comp[at:to], sketch[at:to]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                ab = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], ["a", "b"])

    return run


def _proposals(rows: DataFrame, sketches: DataFrame, seed: int, threshold: float) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.join(sketches.select(F.col("doc_id").alias("rep"), "sketch"), "rep").withColumn("ord", F.xxhash64(F.lit(seed), "key", "rep"))
    full = written(full.select("key", "ord", "rep", "component", "sketch"), "nd-chunk").repartitionByRange(parts, "key", "ord").sortWithinPartitions("key", "ord")
    return full.drop("ord").mapInArrow(_nearest(threshold - 0.11), "a bigint, b bigint").distinct()


def _agreeing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal full registers and of registers full in one at least, for all pairs of rows."""
    same = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(a.T, b.T):
        same += x[:, None] == y[None, :]
    empty = ((a == 0xFFFF).astype(np.float32) @ (b == 0xFFFF).astype(np.float32).T).astype(np.int16)
    return same - empty, M - empty


def _between(threshold: float, percent: int):
    """Rows of two blocks (i, j) of a key to all pairs (a, b) of different components that their registers leave plausible."""

    def run(rows: pa.Table) -> pa.Table:
        rep, comp, n, block, place = (rows.column(c).to_numpy() for c in ("rep", "component", "n_shingles", "block", "place"))
        most = n - place  # of the first shared shingle: what the intersection can hold
        found = [np.zeros((2, 0), np.int64)]
        if (comp != comp[0]).any():
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, M)
            order = np.lexsort((n, comp))
            i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
            left, right = order[block[order] == i], order[block[order] == j]
            for at in range(0, len(left), CHUNK):
                x = left[at : at + CHUNK]
                for to in range(at if i == j else 0, len(right), CHUNK):
                    y = right[to : to + CHUNK]
                    ok = comp[x][:, None] != comp[y][None, :]
                    ok &= 100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :])
                    ok &= (100 + percent) * np.minimum(most[x][:, None], most[y][None, :]) >= percent * (n[x][:, None] + n[y][None, :])
                    if not ok.any():
                        continue
                    same, used = _agreeing(sketch[x], sketch[y])
                    used = np.maximum(used, 1)
                    ok &= same / used + MARGIN * np.sqrt(0.25 / used) >= threshold
                    u, v = np.nonzero(ok)
                    for part in range(0, len(u), 10_000):
                        a, b = x[u[part : part + 10_000]], y[v[part : part + 10_000]]
                        value, error = estimate(sketch[a], sketch[b], n[a].astype(np.float64), n[b].astype(np.float64))
                        near = value + MARGIN * error >= threshold
                        found.append(np.stack([np.minimum(rep[a], rep[b])[near], np.maximum(rep[a], rep[b])[near]]))
        ab = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": ab[0], "b": ab[1]})

    return run


def _bucket_counts(k: int):
    """Texts to partial counts of their shingles' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in kernel.slices(batch.column(0)):
                for s in shingle_sets(data, offsets, k):
                    np.add.at(total, (s >> np.uint64(44)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(total[at[i : i + 100_000]])], ["bucket", "n"])

    return run


def _prefixes(k: int, percent: int, counts):
    """Rows (rep, n_shingles, component, text) to rows (key, place, rep, n_shingles, component): the rarest shingles of each, one more than a partner may lack, and their places from the rarest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.slices(batch.column("text")):
                part, keys, many = batch.slice(a, b - a), [], []
                for s in shingle_sets(data, offsets, k):
                    # a partner shares at least percent / 100 of the shingles
                    m = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    first = np.lexsort((s, counts.value[(s >> np.uint64(44)).astype(np.int64)]))[:m]
                    keys.append(s[first].view(np.int64))
                    many.append(len(first))
                of = pa.array(np.repeat(np.arange(b - a), many))
                place = np.concatenate([np.arange(m) for m in many])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(place, pa.int64()), *(part.column(c).take(of) for c in ("rep", "n_shingles", "component"))], ["key", "place", "rep", "n_shingles", "component"])
        kernel.release()

    return run


def _all_across(rows: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Every plausible pair of different components among the documents of rows(rep, n_shingles, component): they share a shingle
    among the rarest of both, whatever order all agree on, here by counts in BUCKETS buckets. A key's rows are dealt into blocks, and each pair of blocks is one group."""
    own = written(rows.select("rep", "n_shingles", "component").dropDuplicates(["rep"]), "nd-mixed-id")
    if own.count() <= BROADCAST_IDS:
        own = F.broadcast(own)  # all other texts stay where they are
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(own, "rep").dropDuplicates(["rep"])
    texts = written(texts, "nd-mixed-text")
    counts = np.zeros(BUCKETS, np.int32)
    for r in texts.select("text").mapInArrow(_bucket_counts(k), "bucket bigint, n bigint").groupBy("bucket").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).alias("n")).toArrow().to_batches():
        counts[r.column(0).to_numpy()] = r.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    keyed = written(texts.mapInArrow(_prefixes(k, percent, shared), "key bigint, place bigint, rep bigint, n_shingles bigint, component bigint"), "nd-prefix")
    blocks = keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "blocks")
    dealt = skew.spread_join(keyed, blocks, ["key"], ["rep"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = written(dealt, "nd-prefix")
    dealt = dealt.join(sketches.select(F.col("doc_id").alias("rep"), "sketch"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "place", "rep", "component", "n_shingles", "sketch")
    return dealt.groupBy("key", "i", "j").applyInArrow(_between(percent / 100, percent), "a bigint, b bigint").distinct()


def _plausible(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("sketch_a", "sketch_b")]
            n = [batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
            j, error = estimate(*sk, *n)
            yield batch.select(["a", "b"]).filter(pa.array(j + MARGIN * error >= threshold))
        kernel.release()

    return run


def _confirmed(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [[s for _, _, data, offsets in kernel.slices(part.column(c)) for s in shingle_sets(data, offsets, k)] for c in ("text_a", "text_b")]
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)], np.int64)
                total = np.array([len(x) + len(y) for x, y in zip(*sets)], np.int64) - both
                yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * total))
        kernel.release()

    return run


def _verify(pairs: DataFrame, sketches: DataFrame | None, docs: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """Pairs, written before, that the registers make plausible (sketches given) and the full sets confirm."""
    near = pairs
    if sketches is not None:
        both = skew.with_both_ends(pairs, sketches.select("doc_id", "sketch", F.col("n_shingles").alias("n")), "doc_id")
        near = written(both.mapInArrow(_plausible(percent / 100), "a bigint, b bigint"), label)
    ids = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
    if 2 * near.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = written(docs.join(ids, "doc_id", "left_semi"), label)
    both = skew.with_both_ends(near, texts, "doc_id").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(_confirmed(k, percent), "a bigint, b bigint"), label)


def _several(base: DataFrame, sketched: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """base with each (doc_id, text) once, sketches of all rows, and names(doc_id, real). A doc_id with several sets gets a name for each
    text, by a hash of both, and names has them; it is None where there is no such doc_id."""
    differs = [F.min(c) != F.max(c) for c in ("n_shingles", "set_a", "set_b")]
    again = sketched.groupBy("doc_id").agg(F.count("*").alias("_n"), (differs[0] | differs[1] | differs[2]).alias("_differ")).where("_n > 1").select("doc_id", "_differ")
    again = written(again, "nd-again")
    n, unlike = again.agg(F.count("*"), F.count_if("_differ")).first()
    if not n:
        return base, sketched, None
    again = F.broadcast(again) if n <= BROADCAST_IDS else again  # all other texts stay where they are
    named = base.join(again, "doc_id", "left")
    name = F.when(F.col("_differ"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + (1 << 62)).otherwise(F.col("doc_id"))
    named = named.select(name.alias("doc_id"), "text", F.col("doc_id").alias("real"), "_differ")
    once = named.where("_differ IS NULL").select("doc_id", "text").unionByName(named.where("_differ IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"]))
    if not unlike:
        return once, sketched, None
    own = written(named.where("_differ").select("doc_id", "text", "real"), "nd-several")
    rest = sketched.join(again.where("_differ"), "doc_id", "left_anti")
    sketched = written(rest.unionByName(own.select("doc_id", "text").mapInArrow(_sketch(k), _SKETCH)), "nd-sketch")
    return once, sketched, own.select("doc_id", "real").distinct()


def _folded(found: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links) with names back to the doc_ids they stand for: the components of a doc_id's texts are one, named by its least doc_id."""
    found = written(found.join(F.broadcast(names) if names.count() <= BROADCAST_IDS else names, "doc_id", "left"), "nd-found")
    tied = found.where("real IS NOT NULL").select("real", F.col("component_id").alias("b")).distinct()
    edges = written(tied.join(tied.groupBy("real").agg(F.min("b").alias("a")), "real").select("a", "b"), "nd-tied")
    whole = graph.components(edges, "nd-tied").withColumnRenamed("node", "component_id").withColumnRenamed("component", "whole")
    rows = written(found.join(whole, "component_id", "left").withColumn("whole", F.coalesce("whole", "component_id")).withColumn("doc_id", F.coalesce("real", "doc_id")), "nd-found")
    # only components with such a doc_id may be named otherwise than by their least one
    touched = rows.where("real IS NOT NULL").select("whole").distinct()
    least = rows.join(touched, "whole", "left_semi").groupBy("whole").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "whole", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"), "n_links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links). n_links counts the links between the document's class and other classes that the
    search has confirmed; links within a component that were not needed to find it aren't all looked at."""
    every = docs.select("doc_id", F.col(text).alias("text"))
    base = every.where("doc_id IS NOT NULL")
    base, sketched, names = _several(base, written(base.mapInArrow(_sketch(k), _SKETCH), "nd-sketch"), k)
    out = _grouped(base, sketched, k, percent)
    if names is not None:
        out = _folded(out, names)
    nameless = every.where("doc_id IS NULL").mapInArrow(_sketch(k), _SKETCH).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless)


def _grouped(base: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates of documents that have one text each: base(doc_id, text) has each once, sketched may repeat them."""
    # equal sets: one class, its smallest doc_id speaks for it
    classes = sketched.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    member = written(
        skew.spread_join(sketched.where("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b"), classes, ["n_shingles", "set_a", "set_b"], ["doc_id"]).select("doc_id", "n_shingles", "rep"), "nd-class"
    )
    reps = sketched.where("n_shingles > 0").join(member.where("rep = doc_id").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = written(reps.select("doc_id", "n_shingles", "sketch", "keys"), "nd-rep")
    keyed = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"), "n_shingles")
    pairs, open_rows = _candidates(keyed.withColumn("component", F.col("rep")), "nd-pair", F.col("rep"), False)
    tested = written(pairs, "nd-tested")
    links = _verify(tested, reps, base, k, percent, "nd-link")
    # how often a document of a large group meets others under a key: originals of edited copies come first
    weight = open_rows.groupBy("rep").agg(F.sum("beside").alias("weight"))
    open_rows = written(open_rows.drop("beside").join(weight, "rep"), "nd-open")

    def still_mixed() -> tuple[DataFrame, DataFrame]:
        labels = written(graph.components(links, "nd-cc"), "nd-label")
        linked = open_rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n_shingles", "weight", F.coalesce("component", "rep").alias("component"))
        linked = written(linked, "nd-linked")
        mixed = linked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return labels, written(skew.spread_join(linked, mixed, ["key"], ["rep"]), "nd-mixed")

    labels, left = still_mixed()
    round_ = 0
    while not left.isEmpty():
        last = round_ == ROUNDS
        if round_ == 0:
            more = _candidates(left, "nd-pair", -F.col("weight"), True)[0]
        elif not last:
            more = _proposals(left, reps, round_, percent / 100)
        else:
            more = _all_across(left, reps, base, k, percent)
        more = written(more.join(tested, ["a", "b"], "left_anti"), "nd-tested")
        new = _verify(more, None if round_ else reps, base, k, percent, "nd-link")
        tested = tested.unionByName(more)
        nothing = new.isEmpty()
        if not nothing:
            links = links.unionByName(new)
            labels, left = still_mixed()
        if last:
            break
        round_ = ROUNDS if round_ and nothing else round_ + 1
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = member.where("rep = doc_id").select("rep").distinct().join(labels.withColumnRenamed("node", "rep"), "rep").join(degree, "rep", "left")
    out = member.join(named, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    empty = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(empty)


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, k=4).drop("n_links").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i+3], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)

SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id)::BIGINT AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""

"""Operator 4, substring dedup by relative Lempel-Ziv parsing against an index of the whole corpus.

Equal texts are one document here, found first by two hashes of the text: each of their words goes (if they have a window at all), one of
them stands for all in the index, and the others are never looked into. The reference is the corpus itself, indexed in blocks: a block is a
range of fingerprints of k-word windows, so a document is factored against every block by sending its windows to the ranges that they fall
into. Windows are equal where two 64-bit fingerprints are. Content-chosen anchors (the least A-word hash of each window) come first: a window
can only occur twice if its anchor does, so windows without such an anchor never travel. Each window that occurs elsewhere learns up to
REFERENCES places where it does. The parse then is greedy: at the first window with a reference, the place that runs on longest with the
document is the factor; the next factor starts behind its last window. Every window is checked, those across factor boundaries too, so the words
of the factors are exactly those of the duplicate windows.

Null or empty text: no words, nothing removed, kept text ''. Repeated rows are copies of each other, so every window of
theirs occurs elsewhere. A null doc_id, and one that stands with several texts, gives way to a hash of itself and the text while rows are
told apart (in ref_doc too). References are the smallest (doc_id, place) of a block; ties in length go to the smaller one. Other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm import kernel, skew
from kbforge.llm.scratch import written

#: Words of a window; words of an anchor.
WINDOW, ANCHOR = 35, 12
#: Places of a window that its copies are told.
REFERENCES = 2
#: Unclear doc_ids, and classes of equal texts, that are broadcast at most.
BROADCAST_IDS = 1_000_000

_LONG = pa.list_(pa.int64())
_INT = pa.list_(pa.int32())


def _least(w: kernel.Words, hashes: np.ndarray, k: int, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash at each word; least anchor hash of the window at each word, 0 where no window of its document starts; whether it starts there."""
    g = kernel.windows(hashes, a)
    n = len(hashes)
    starts = np.zeros(n, bool)
    if n < k:
        return g, np.zeros(n, np.uint64), starts
    ends = np.repeat(w.first[1:], np.diff(w.first))
    starts = np.arange(n) + k <= ends
    least = np.zeros(n, np.uint64)
    found = kernel.sliding_min(g, k - a + 1)
    least[: len(found)] = found
    least[~starts] = 0
    return g, least, starts


def _anchors(k: int, a: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kernel.slices(batch.column(1)):
                w = kernel.Words(data, offsets)
                g, least, _ = _least(w, w.hashes(fold=False), k, a)
                # a place is an anchor if it is least in some window over it
                back = np.concatenate([np.zeros(k - a, np.uint64), least[: len(g)]])
                most = ~kernel.sliding_min(~back, k - a + 1) if len(g) else g
                at = np.flatnonzero(g == most)
                cut = np.searchsorted(at, w.first)
                chosen = pa.array(g[at].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), chosen)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "anchors"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (h, doc_id): those whose h comes again, and those at the partition's ends, where it might."""
    held = None
    opening = True
    for batch in batches:
        h, doc = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(h):
            continue
        if held is not None:
            h, doc = np.concatenate([held[0], h]), np.concatenate([held[1], doc])
        again = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        again[1:] |= same
        again[:-1] |= same
        if held is not None:
            again[0] |= held[2]
        if opening:
            again[0], opening = True, False
        yield from _pairs(h[:-1][again[:-1]], doc[:-1][again[:-1]])
        held = (h[-1:], doc[-1:], bool(again[-1]))
    if held is not None:
        yield from _pairs(held[0], held[1])


def _pairs(h: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(h):
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h)], ["doc_id", "h"])


def _candidates(k: int, a: int):
    """Rows (doc_id, text, many, seeds) to their windows that have a seed for their anchor. Rows that stand for many equal texts are done with here but for their windows; they and those without a window leave their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kernel.slices(batch.column("text")):
                w = kernel.Words(data, offsets)
                hashes = w.hashes(fold=False)
                _, least, starts = _least(w, hashes, k, a)
                prints, checks = kernel.windows(hashes, k), kernel.windows(kernel.mix(hashes, 0x7F4A7C15), k)
                part = batch.slice(lo, hi - lo)
                seeds, many = part.column("seeds").to_pylist(), part.column("many").to_pylist()
                n, sha, fps, seconds, places, keep = [], [], [], [], [], []
                raw = data.tobytes()
                for i, (x, y) in enumerate(zip(w.first, w.first[1:])):
                    at = np.zeros(0, np.int64)
                    if seeds[i]:
                        at = np.flatnonzero(np.isin(least[x:y], np.array(seeds[i], np.int64).view(np.uint64)) & starts[x:y])
                    n.append(int(y - x))
                    keep.append(len(at) > 0 and not many[i])
                    fps.append(prints[x + at].view(np.int64))
                    seconds.append(checks[x + at].view(np.int64))
                    places.append(at.astype(np.int32))
                    kept = b"" if many[i] and y - x >= k else None if keep[-1] else b" ".join(raw[s:e] for s, e in zip(w.starts[x:y].tolist(), w.ends[x:y].tolist()))
                    sha.append(None if kept is None else hashlib.sha256(kept).hexdigest())
                text = part.column("text")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("many"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array([text[i].as_py() if x else None for i, x in enumerate(keep)], pa.string()), pa.array(fps, _LONG), pa.array(seconds, _LONG), pa.array(places, _INT)],
                    ["doc_id", "many", "n_words", "kept_sha256", "text", "prints", "checks", "places"],
                )

    return run


_PARSED = "doc_id bigint, many boolean, n_words bigint, kept_sha256 string, text string, prints array<bigint>, checks array<bigint>, places array<int>"
_REFERENCE = ["doc_id", "place", "ref_doc", "ref_place", "print", "check", "n", "many"]


def _references(most: int):
    """Sorted rows (print, check, doc_id, place, many) to (doc_id, place, ref_doc, ref_place, ...): up to `most` reference places of each window
    that comes again, n null; windows of rows that stand for many need none. Of the first and the last window of a partition, which may go on
    next door, the first row is given with the number of rows at hand in n."""

    def made(cols: list[np.ndarray], i: np.ndarray, ref: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000], ref[at : at + 100_000]
            rest = [pa.nulls(len(x), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[2][x]), pa.array(cols[3][x]), pa.array(cols[2][y]), pa.array(cols[3][y]), *rest, pa.nulls(len(x), pa.bool_())], _REFERENCE)

    def settled(cols: list[np.ndarray], told: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """References of the rows that aren't told yet; begin, end: of each row's group."""
        i = np.flatnonzero(~told & ~cols[4])
        for r in range(most):
            ref = begin[i] + r
            ref += ref >= i  # not itself
            ok = ref < end[i]
            yield from made(cols, i[ok], ref[ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, np.zeros(0, bool)  # the open group: all its rows, or the first ones, told already, if there are more than a row can need
        size = 0  # of the open group, with what isn't held
        first = None  # the partition's first group: print, check, doc_id, place, many, rows
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("print", "check", "doc_id", "place", "many")]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            told = np.concatenate([told, np.zeros(len(cols[0]) - len(told), bool)])
            fresh = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            at = np.flatnonzero(fresh)
            counts = np.diff(np.append(at, len(fresh)))
            beyond = size - (0 if held is None else len(held[0]))  # rows of the first group at hand that were let go
            if len(at) > 1 and first is None:
                first = (*(x[0] for x in cols), int(counts[0]) + beyond)
            size = int(counts[-1]) + (beyond if len(at) == 1 else 0)
            begin, end = np.repeat(at, counts), np.repeat(at + counts, counts)
            last = int(at[-1])
            ready = np.ones(len(fresh), bool)
            if counts[-1] <= most:  # later rows may still be references
                ready[last:] = False
            yield from settled([x[: last if not ready[-1] else None] for x in cols], told[: last if not ready[-1] else None], begin, end)
            stop = len(fresh) if not ready[-1] else last + most + 1
            held, told = [x[last:stop] for x in cols], told[last:stop] | ready[last:stop]
        if held is None:
            return
        n = len(held[0])
        yield from settled(held, told, np.zeros(n, np.int64), np.full(n, n))
        ends = [(*(x[0] for x in held), size)] + ([first] if first is not None else [])
        p, c, doc, place, many, rows = zip(*ends)
        m = len(ends)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(p, pa.int64()), pa.array(c, pa.int64()), pa.array(rows, pa.int64()), pa.array(many, pa.bool_())], _REFERENCE)

    return run


def factors_of(places: np.ndarray, ref_doc: np.ndarray, ref_place: np.ndarray, k: int) -> np.ndarray:
    """Greedy factors [n, 4] (start, words, reference document, reference start) from windows and their references, several for one place: from
    each start the reference that runs on longest. Windows of one reference that touch imply those between them, which may know other places."""
    if not len(places):
        return np.zeros((0, 4), np.int64)
    shift = ref_place - places
    order = np.lexsort((places, shift, ref_doc))
    p, d, f = places[order], ref_doc[order], shift[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(p) > k) | (d[1:] != d[:-1]) | (f[1:] != f[:-1])]))
    size = np.diff(np.append(cut, len(p)))
    until = np.repeat(p[cut + size - 1], size)  # the last window of each run
    best = np.lexsort((f, d, -until, p))
    best = best[np.concatenate([[True], p[best][1:] != p[best][:-1]])]
    p, d, f, until = p[best], d[best], f[best], until[best]
    out, i = [], 0
    while i < len(p):
        out.append((p[i], until[i] - p[i] + k, d[i], p[i] + f[i]))
        i = int(np.searchsorted(p, until[i], "right"))
    return np.array(out, np.int64)


def _removed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kernel.slices(batch.column("text")):
                w = kernel.Words(data, offsets)
                raw = data.tobytes()
                part = batch.slice(lo, hi - lo)
                n, gone, sha, kept_text, facts = [], [], [], [], []
                for i, (x, y) in enumerate(zip(w.first, w.first[1:])):
                    found = part.column("found")[i].values
                    keep = np.ones(y - x, bool)
                    facts.append([])
                    if found is not None and len(found):
                        fs = factors_of(*(np.asarray(found.field(f)).astype(np.int64) for f in ("place", "ref_doc", "ref_place")), k)
                        for start, words, *_ in fs:
                            keep[start : start + words] = False
                        facts[-1] = [dict(zip(("start", "n_words", "ref_doc", "ref_start"), f)) for f in fs.tolist()]
                    s, e = w.starts[x:y], w.ends[x:y]
                    n.append(int(y - x))
                    gone.append(int((~keep).sum()))
                    sha.append(hashlib.sha256(b" ".join(raw[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist()))).hexdigest())
                    # a removed word goes with the white space behind it
                    upto = np.append(s[1:], offsets[i + 1]) if y > x else s
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                    kept_text.append(b"".join(raw[s[a] : upto[b - 1]] for a, b in edges.reshape(-1, 2)).decode() if gone[-1] else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept_text, pa.string()), pa.array(facts, _FACTS)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"],
                )

    return run


_FACTS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())]))
_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, factors array<struct<start:bigint,n_words:bigint,ref_doc:bigint,ref_start:bigint>>"


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text, ...) with `_key`: doc_id, or a hash of it and the text where it is null or stands with several texts."""
    own = F.xxhash64("doc_id", F.coalesce(F.col(text), F.lit("")))
    unclear = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi OR _id IS NULL").select("_id", F.lit(True).alias("_unclear"))
    unclear = written(unclear, "ss-unclear")
    n = unclear.count()
    if not n:
        return docs.withColumn("_key", F.col("doc_id"))
    found = docs.join(F.broadcast(unclear) if n <= BROADCAST_IDS else unclear, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return found.withColumn("_key", F.when(F.col("_unclear"), own).otherwise(F.col("doc_id"))).drop("_id", "_unclear")


_NO_FACTORS = "CAST(array() AS array<struct<start:bigint,n_words:bigint,ref_doc:bigint,ref_start:bigint>>)"


def _classes(named: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """named(doc_id, _key, text) with the hashes h1 and h2 of the text, and the texts that come more than once as (h1, h2, first, second), two of their keys; None if there are none."""
    rows = named.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(17), "text")})
    again = rows.groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.min("_key").alias("first"), F.max("_key").alias("second")).where("_n > 1").drop("_n")
    again = written(again, "ss-equal")
    n = again.count()
    return rows, None if not n else F.broadcast(again) if n <= BROADCAST_IDS else again


def remove_repeats(docs: DataFrame, k: int = WINDOW, anchor: int = ANCHOR, text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept_text, factors); kept_text is null where nothing was removed."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = keyed(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")))
    rows, again = _classes(named)
    same = ["h1", "h2"]
    if again is None:
        base = rows.select(F.col("_key").alias("doc_id"), "text", F.lit(False).alias("many"))
    else:
        # one of equal texts for all of them
        one = rows.join(again, same).where("_key = first").select(F.col("_key").alias("doc_id"), "text").groupBy("doc_id").agg(F.first("text").alias("text"))
        base = rows.join(again.select(*same), same, "left_anti").select(F.col("_key").alias("doc_id"), "text", F.lit(False).alias("many"))
        base = base.unionByName(written(one, "ss-one").withColumn("many", F.lit(True)))
    anchors = written(base.select("doc_id", "text").mapInArrow(_anchors(k, anchor), "doc_id bigint, anchors array<bigint>"), "ss-anchor")
    places = anchors.select(F.explode("anchors").alias("h"), "doc_id").repartitionByRange(parts, "h", "doc_id").sortWithinPartitions("h", "doc_id")
    seeds = places.mapInArrow(_repeated, "doc_id bigint, h bigint").groupBy("doc_id").agg(F.collect_set("h").alias("seeds"))
    parsed = written(base.join(seeds, "doc_id", "left").mapInArrow(_candidates(k, anchor), _PARSED), "ss-parsed")
    windows = parsed.select("doc_id", "many", F.explode(F.arrays_zip("prints", "checks", "places")).alias("w"))
    windows = windows.select(F.col("w.prints").alias("print"), F.col("w.checks").alias("check"), "doc_id", F.col("w.places").alias("place"), "many")
    order = ["print", "check", "doc_id", "place"]
    windows = windows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    refs = written(windows.mapInArrow(_references(REFERENCES), "doc_id bigint, place int, ref_doc bigint, ref_place int, print bigint, check bigint, n bigint, many boolean"), "ss-refs")
    # a window cut by partitions' ends: parts of one row each learn from one another
    ends = refs.where("n IS NOT NULL")
    whole = ends.groupBy("print", "check").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "place")).alias("lo"), F.max(F.struct("doc_id", "place")).alias("hi")).where("c > 1")
    other = F.when(F.struct("doc_id", "place") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    lone = ends.where("n = 1 AND NOT many").join(whole, ["print", "check"]).select("doc_id", "place", other["doc_id"].alias("ref_doc"), other["place"].alias("ref_place"))
    found = refs.where("n IS NULL").select("doc_id", "place", "ref_doc", "ref_place").unionByName(lone)
    # a document has REFERENCES rows for each of its windows at most
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("place", "ref_doc", "ref_place")).alias("found"))
    some = parsed.where("text IS NOT NULL").select("doc_id", "text").join(found, "doc_id", "left").mapInArrow(_removed(k), _OUT)
    none = parsed.where("text IS NULL AND NOT many").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"), F.expr(_NO_FACTORS).alias("factors"))
    out = some.unionByName(none)
    # keys that aren't doc_ids go back; there are none but for unclear rows
    other = named.where("NOT (doc_id <=> _key)").select("_key", F.col("doc_id").alias("_doc_id"), F.lit(True).alias("_other")).distinct()
    if not other.isEmpty():
        out = out.join(other, out["doc_id"] == other["_key"], "left").withColumn("doc_id", F.when(F.col("_other"), F.col("_doc_id")).otherwise(F.col("doc_id"))).drop("_key", "_doc_id", "_other")
    return out if again is None else out.unionByName(_equal(rows, again, parsed, k))


def _equal(rows: DataFrame, again: DataFrame, parsed: DataFrame, k: int) -> DataFrame:
    """Results of the rows whose text comes more than once: everything goes, as one factor, unless the text is shorter than a window."""
    done = parsed.where("many").select(F.col("doc_id").alias("first"), "n_words", "kept_sha256")
    light = rows.select("doc_id", "_key", "h1", "h2").join(again, ["h1", "h2"])
    light = skew.spread_join(written(light, "ss-copies"), done, ["first"], ["doc_id", "_key"])
    gone = F.col("n_words") >= k
    source = F.when(F.col("_key") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    factor = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), "n_words", source.alias("ref_doc"), F.lit(0).cast("bigint").alias("ref_start")))
    return light.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"), "kept_sha256", F.when(gone, F.lit("")).alias("kept_text"), F.when(gone, factor).otherwise(F.expr(_NO_FACTORS)).alias("factors")
    )


def op4(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+{WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, list_sort(list(DISTINCT i + j)) AS gone FROM r, (SELECT unnest(range({WINDOW})) AS j) GROUP BY doc_id),
one AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT one.doc_id, string_agg(x, ' ' ORDER BY one.i) AS kept FROM one LEFT JOIN (SELECT doc_id, unnest(gone) AS i, true AS hit FROM c) d ON d.doc_id = one.doc_id AND d.i = one.i WHERE hit IS NULL GROUP BY one.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

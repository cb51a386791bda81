"""Operator 11, benchmark decontamination by a generalised suffix automaton.

The automaton holds the normalised texts of the test items. Training tokens stream through it, and the length of the longest suffix that
occurs in an item is tracked token by token; where it reaches `window` words, these words are hit, as are whole items of fewer words.
Spans of hit words are cut out; documents of which more than a share is hit go altogether.

Most tokens never reach the automaton's second level. Its first two levels are therefore kept as sorted arrays, too: slices of text are looked up
by vector operations, and only runs of words whose every pair stands in an item, and that are long enough for a window, walk the automaton. A
match of two words or more lies within such a run, so no length is lost. The items are dealt into automata of at most BLOCK_WORDS words (one
item at least); documents pass through one after another, their marks going along, with a written table in between, so what a worker holds is
bounded by a block whatever the number of items. No row is shuffled.

Null or empty texts have no words and are kept. Items without words occur nowhere. A null item_id marks words but is no item that could be
named; rows with the same item_id are one item. Repeated rows and null doc_ids each give a row. Empty tables on either side are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.llm import kernel, terms
from kbforge.llm.scratch import written

#: Words that make a hit; words of items in one automaton.
WINDOW, BLOCK_WORDS = 10, 200_000
#: A document with a larger share of hit words goes as a whole; smaller spans than this are cut from the others.
MAX_COVERAGE = 0.5


class Automaton:
    """Suffix automaton of many token sequences. State 0 is the empty string; `window` is the length of match that counts."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._windows(coded)
        self._pairs(coded)

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of exactly length(p) + 1 words on the arc p -w-> q, cloned from q if need be."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item begins alike
            return self._split(last, w, q)
        made = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, w, self.next[p][w])
        return made

    def _windows(self, coded: list[tuple[int, list[int]]]) -> None:
        """at: for a state that is matched over `window` words or more, the state of its last `window` words; items of these states;
        short: whole items of fewer words that end in a state, and the nearest state up the links that has some."""
        n = len(self.length)
        self.at, self.shorter = [-1] * n, [-1] * n
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.at[s] = s if self.length[up] < self.window else self.at[up]
        for item, words in coded:
            s = 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if i + 1 >= self.window:
                    self.items.setdefault(self.at[s], set()).add(item)
            if len(words) < self.window:
                self.short.setdefault(s, []).append((len(words), item))
        for s in order:
            self.shorter[s] = s if s in self.short else self.shorter[self.link[s]]

    def _pairs(self, coded: list[tuple[int, list[int]]]) -> None:
        """Sorted pairs of neighbouring words in all items, those that begin short items, and words that are items."""
        size = np.int64(len(self.vocabulary))
        pair = lambda a, b: np.int64(a) * size + b
        self.pairs = np.unique(np.array([pair(a, b) for _, ws in coded for a, b in zip(ws, ws[1:])], np.int64))
        short = [ws for _, ws in coded if len(ws) < self.window]
        self.opening = np.unique(np.array([pair(ws[0], ws[1]) for ws in short if len(ws) > 1], np.int64))
        self.single = np.unique(np.array([ws[0] for ws in short if len(ws) == 1], np.int64))
        self.words = pa.array(list(self.vocabulary), pa.large_binary())

    def walk(self, words: list[int], begin: int, spans: list[tuple[int, int, int]], found: set[int]) -> None:
        """Adds (first word, word after the last, longest match) of each maximal union of hits in the words from place `begin` on, and the items hit."""
        nexts, links, lengths, window = self.next, self.link, self.length, self.window
        state = match = 0
        first, to, longest = -1, -1, 0
        for i, w in enumerate(words, begin + 1):  # i: the place behind the word
            arcs = nexts[state]
            while w not in arcs and state:
                state = links[state]
                match = lengths[state]
                arcs = nexts[state]
            if w not in arcs:
                match = 0
                continue
            state = arcs[w]
            match += 1
            start = i
            if match >= window:
                start = i - window
                found |= self.items[self.at[state]]
            s = self.shorter[state]
            while s >= 0:
                for size, item in self.short[s]:
                    if size <= match:
                        start = min(start, i - size)
                        found.add(item)
                s = self.shorter[links[s]]
            if start < i:
                if start > to:
                    if to >= 0:
                        spans.append((first, to, longest))
                    first, longest = start, 0
                else:
                    first = min(first, start)
                to, longest = i, max(longest, match)
        if to >= 0:
            spans.append((first, to, longest))


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def _runs(a: Automaton, ids: np.ndarray, row_of: np.ndarray) -> list[tuple[int, int]]:
    """Runs [from, to) of words of one row that are worth a walk: every pair of neighbours stands in an item, and a window or a short item fits."""
    n = len(ids)
    if not n:
        return []
    joined = np.zeros(n, bool)  # with the word after it
    codes = ids[:-1] * np.int64(len(a.words)) + ids[1:]
    both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (row_of[:-1] == row_of[1:]))
    joined[both] = _in(a.pairs, codes[both])
    begins = np.concatenate([[0], np.flatnonzero(~joined[:-1]) + 1])
    sizes = np.diff(np.append(begins, n))
    worth = sizes >= a.window
    if len(a.opening) or len(a.single):
        marks = _in(a.single, ids)
        pairs = np.flatnonzero(joined)
        marks[pairs] |= _in(a.opening, codes[pairs])
        worth |= np.logical_or.reduceat(marks, begins)
    return list(zip(begins[worth].tolist(), (begins[worth] + sizes[worth]).tolist()))


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping or touching spans joined, for marks that come from several automata."""
    out: list[tuple[int, int, int]] = []
    for a, b, longest in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(longest, out[-1][2]))
        else:
            out.append((a, b, longest))
    return out


MARKS = "struct<n_words:bigint,n_hit:bigint,item_ids:array<string>,spans:array<struct<start:bigint,end:bigint,longest:bigint>>,kept_text:string>"
_MARKS = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("longest", pa.int64())]))), ("kept_text", pa.string()),
])


def _cut(data: np.ndarray, t: terms.Terms, first: int, begin: int, end: int, spans: list[tuple[int, int, int]]) -> str:
    """The row's text without the bytes from the first to the last word of each span, and the gap behind it."""
    parts, at = [], begin
    for a, b, _ in spans:
        parts.append(data[at : t.starts[first + a]].tobytes())
        at = int(t.starts[first + b]) if first + b < len(t.starts) and t.starts[first + b] < end else int(t.ends[first + b - 1])
    parts.append(data[at:end].tobytes())
    return b"".join(parts).decode("utf-8", "replace")


def _marked(docs: DataFrame, text: str, block: list[tuple[str | None, list[bytes]]], window: int, before: str | None) -> DataFrame:
    """docs with `_marks` against one block of items, joined to those that column `before` has."""
    names = [i for i, _ in block]
    shared = docs.sparkSession.sparkContext.broadcast((Automaton([(k, words) for k, (_, words) in enumerate(block)], window), names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, ids_of = shared.value
        for batch in batches:
            columns = [c for c in batch.schema.names if c != before]
            where = batch.schema.get_field_index(text)
            for first, last, data, offsets, t in terms.slices(batch.column(where)):
                part = batch.slice(first, last - first)
                marks = marks_of(a, ids_of, data, offsets, t, part.column(before).to_pylist() if before else None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), marks], [*columns, "_marks"])
            kernel.release()

    def marks_of(a: Automaton, ids_of: list, data: np.ndarray, offsets: np.ndarray, t: terms.Terms, had: list | None) -> pa.Array:
        ids = pc.fill_null(pc.index_in(t.values, value_set=a.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.diff(t.first)
        row_of = np.repeat(np.arange(len(counts)), counts)
        spans: dict[int, list[tuple[int, int, int]]] = {}
        items: dict[int, set[int]] = {}
        for begin, end in _runs(a, ids, row_of):
            row = int(row_of[begin])
            a.walk(ids[begin:end].tolist(), begin - int(t.first[row]), spans.setdefault(row, []), items.setdefault(row, set()))
        out = []
        for row, n in enumerate(counts.tolist()):
            own = had[row] if had else None
            if own is None and not spans.get(row):
                out.append({"n_words": n, "n_hit": 0, "item_ids": [], "spans": [], "kept_text": None})
                continue
            all_spans = _merged([*spans.get(row, ()), *((s["start"], s["end"], s["longest"]) for s in (own or {}).get("spans", ()))])
            named = sorted({ids_of[i] for i in items.get(row, ()) if ids_of[i] is not None} | set((own or {}).get("item_ids", ())))
            kept = _cut(data, t, int(t.first[row]), int(offsets[row]), int(offsets[row + 1]), all_spans) if all_spans else None
            out.append({"n_words": n, "n_hit": sum(b - a for a, b, _ in all_spans), "item_ids": named, "spans": [dict(zip(("start", "end", "longest"), s)) for s in all_spans], "kept_text": kept})
        return pa.array(out, _MARKS)

    rest = [f for f in docs.schema.fields if f.name != before]
    return docs.mapInArrow(run, T.StructType([*rest, *T.StructType.fromDDL(f"_marks {MARKS}").fields]))


def _blocks(items: DataFrame, item_id: str, text: str, window: int, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of about `most` words at most, longer items in pieces that share their windows; the driver holds one block at a time."""
    block, size = [], 0
    for name, t in items.select(F.col(item_id).cast("string"), text).toLocalIterator():
        words = terms.of_text(t)
        for at in range(0, max(len(words) - window + 1, min(len(words), 1)), most):
            piece = words[at : at + most + window - 1]
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
    yield block


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the struct `_marks`: n_words, n_hit, the item_ids that occur (sorted as strings), spans (start, end: words; longest: the
    longest match in the span, in words) and kept_text (null where nothing is cut)."""
    out, before = docs, None
    blocks = _blocks(items, item_id, item_text, window, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        out = _marked(out, text, block, window, before)
        if following is not None:
            out = written(out.withColumnRenamed("_marks", "_before"), "decontamination")
            before = "_before"
        block = following
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without the spans that match `window` words of an item or a whole shorter item; documents with a larger share of hit words
    than max_coverage go altogether. Columns as before, those of equal names to the ones used here included."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text"))
    rows = marked(whole, items, window=window).where(F.col("_marks.n_hit") <= max_coverage * F.col("_marks.n_words"))
    return rows.select(*[(F.coalesce("_marks.kept_text", "text") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    m = F.col("_marks")
    rows = marked(docs.select("doc_id", "text"), benchmark)
    return rows.select(
        "doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["item_ids"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", m["item_ids"]), 256).alias("items_sha256"), (m["n_hit"] > 0).alias("contaminated"),
    )


_SIZES = "(SELECT DISTINCT k FROM b)"
#: DuckDB SQL: the windows of items joined to those of documents.
ORACLE_SQL = (
    f"WITH i AS (SELECT item_id, {terms.sql_terms('text')} AS w FROM benchmark), "
    f"b AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, least({WINDOW}, len(w)) AS k, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)), "
    f"d AS (SELECT row_number() OVER () AS r, doc_id, {terms.sql_terms('text')} AS w FROM documents), "
    f"g AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, {_SIZES} WHERE len(w) >= k)), "
    "h AS (SELECT r, s, k, item_id FROM g JOIN b USING (k, g)), "
    "c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM h) GROUP BY r), "
    "t AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r) "
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated "
    "FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"
)

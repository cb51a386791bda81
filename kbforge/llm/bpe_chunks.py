"""Operator 9, byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. The pre-tokeniser looks ahead but never
back, so two chunks agree from the first boundary that both have in their overlap. They are stitched there, or at the first one
after it at which a piece can end: the pattern asks what follows white space, so a piece that ended in some would be split
otherwise than within its text. Pieces end behind a character that is no white space, where white space or the end of a run
of letters makes a boundary in any version of Unicode. The stitched pieces are encoded in parallel and joined again. Where no such
boundary is common (a run longer than the overlap), the piece before is carried on through the next chunk. Decoding
concatenates the raw bytes of the ids.

Null or empty text: no ids, the digests are those of the empty string. Repeated rows each give a row, texts that share
a doc_id are kept apart by their hash; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points from one chunk's start to the next, and by how many a chunk reaches into the next.
STEP, OVERLAP = 32_768, 512
#: Boundaries nearer to a cut end than the longest look-ahead of the pattern are not trusted.
LOOKAHEAD = 3

_KEYS = ("row", "doc_id", "copies")
_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]

    def boundaries(self, text: str) -> np.ndarray:
        """0 and the end of each pre-token."""
        return np.cumsum(np.fromiter((len(x) for x in self.pattern.findall(text)), np.int64), dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


def codec(ranks_path: str, pattern: str) -> Codec:
    """One per worker process."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def may_end(text: str, at: int) -> bool:
    """Whether a piece can end at the boundary `at` within text: both sides, encoded alone, give the ids that they have together."""
    before, after = text[at - 1 : at], text[at : at + 1]
    if not before or not after or before.isspace():
        return False
    if after.isspace():
        return not "\x1c" <= after <= "\x1f"  # white space to some, symbols to others
    return before.isalpha() and after != "'" and not after.isalnum() and unicodedata.category(after)[0] in "PS"


def stitch(chunks: list[tuple[int, str]], bounds: list[np.ndarray], step: int, pre) -> list[tuple[int, str]]:
    """Pieces (start, text) between true pre-token boundaries. chunks: (start, text) in order; bounds: their boundaries, from pre(text)."""
    pieces: list[tuple[int, str]] = []
    start, text = chunks[0]
    known = np.concatenate([[0], bounds[0]]) + start
    begin = start  # where the next piece starts: a true boundary within text
    for (at, more), ends in zip(chunks[1:], bounds[1:]):
        sure = known[known <= start + len(text) - LOOKAHEAD]
        other = np.concatenate([[0], ends]) + at
        common = np.intersect1d(sure[sure >= at], other)
        cut = next((x for x in common.tolist() if may_end(text, x - start)), None)
        if cut is not None:
            if cut > begin:
                pieces.append((begin, text[begin - start : cut - start]))
            begin, start, text, known = cut, at, more, other[other >= cut]
        else:
            # go on from the last trusted boundary, which may lie on either side of the next chunk's start
            last = next((x for x in sure[sure > begin][::-1].tolist() if may_end(text, x - start)), begin)
            if last > begin:
                pieces.append((begin, text[begin - start : last - start]))
            text = more[last - at :] if last >= at else text[last - start : at - start] + more
            begin = start = last
            known = np.concatenate([[0], pre(text)]) + start
    if start + len(text) > begin:
        pieces.append((begin, text[begin - start :]))
    return pieces


def _digest(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.encoding.decode_bytes(ids)).hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """Rows (row, doc_id, ids array<int>) of every document, long ones by overlapping chunks."""
    return _encoded(docs, ranks_path, pattern, text, step, overlap, False)


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), ids encoded and decoded again."""
    return _encoded(docs, ranks_path, pattern, text, step, overlap, True)


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str, step: int, overlap: int, digest: bool) -> DataFrame:
    out_schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "doc_id bigint, ids array<int>"

    def batch_of(c: Codec, keys: list[int], ids: list[list[int]]) -> pa.RecordBatch:
        if not digest:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        n, a, b = zip(*(_digest(c, x) for x in ids))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield batch_of(c, part.column(0).to_pylist(), [c.encode(t or "") for t in part.column(1).to_pylist()])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                ends = [c.boundaries(t).tobytes() for t in part.column("chunk").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ends, pa.binary())], [*part.schema.names, "ends"])

    def stitched(chunks: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        rows = sorted(zip(chunks.column("at").to_pylist(), chunks.column("chunk").to_pylist(), chunks.column("ends").to_pylist()))
        pieces = stitch([(a, t) for a, t, _ in rows], [np.frombuffer(e, np.int64) for _, _, e in rows], step, c.boundaries)
        n = len(pieces)
        return pa.table({**{k: pa.repeat(chunks.column(k)[0], n) for k in _KEYS}, "at": pa.array([a for a, _ in pieces], pa.int64()), "piece": pa.array([t for _, t in pieces])})

    def pieces_to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                ids = [np.array(c.encode(t), np.uint32).tobytes() for t in part.column("piece").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in _KEYS), part.column("at"), pa.array(ids, pa.binary())], [*_KEYS, "at", "ids"])

    def joined(pieces: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        rows = sorted(zip(pieces.column("at").to_pylist(), pieces.column("ids").to_pylist()))
        made = batch_of(c, [pieces.column("doc_id")[0].as_py()], [np.frombuffer(b"".join(x for _, x in rows), np.uint32).tolist()])
        return pa.Table.from_batches([made]).add_column(0, "copies", pieces.column("copies").slice(0, 1))

    # Equal long rows encode alike: one of them goes through the chunks, and its result is repeated.
    body = docs.select("doc_id", F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > step, F.lit(False))
    whole = body.where(~is_long).mapInArrow(short, out_schema)
    long = body.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("row", F.xxhash64("text"))
    at = F.expr(f"explode(sequence(0L, CAST(length(text) - 1 AS BIGINT), {step}L)) AS at")
    chunks = long.select("row", "doc_id", "copies", "text", at).withColumn("chunk", F.expr(f"substring(text, CAST(at AS INT) + 1, {step + overlap})")).drop("text")
    key = "row bigint, doc_id bigint, copies bigint"
    cut = chunks.mapInArrow(pretokenise, f"{key}, at bigint, chunk string, ends binary").groupBy("row", "doc_id", "copies").applyInArrow(stitched, f"{key}, at bigint, piece string")
    encoded = cut.mapInArrow(pieces_to_ids, f"{key}, at bigint, ids binary").groupBy("row", "doc_id", "copies").applyInArrow(joined, f"copies bigint, {out_schema}")
    encoded = encoded.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    return whole.unionByName(encoded)


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes other than space and U+0009..U+000D; document borders end words too.
Hashes are polynomial prefix sums modulo 2**64 over random byte codes, finished by a bijective mixer,
so every window hash costs a few vector operations whatever its length. Very long words are hashed one by one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time: a worker's tables and arrays take some 60 times as much.
SLICE_BYTES = 1 << 19

#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 256

_rng = np.random.default_rng(20240917)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_CODE_FOLDED = _BYTE_CODE[_FOLD]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_libc = ctypes.CDLL(None)
if not (hasattr(_libc, "mallopt") and hasattr(_libc, "malloc_trim")):  # not glibc
    _libc = None
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _tables.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE[kind], pow(_BASE[kind], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _tables[kind] = have
    return have


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of at most `limit` bytes, one row at least. A null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of consecutive rows of at most `limit` bytes, one row at least, of strings or binaries."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to


def keep_freed() -> None:
    """For steps that make the same large arrays over and over: the C library keeps some freed memory until release(), where it would give it
    back and have its pages faulted in again at every step. Both bounds are below those that glibc comes to by itself."""
    if _libc is not None:
        _libc.mallopt(_MMAP_THRESHOLD, 16 << 20)
        _libc.mallopt(_TRIM_THRESHOLD, 32 << 20)


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back: a worker waits for its next task with as little as it can."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


class Words:
    """starts, ends: byte places of all words (runs of bytes that `of` has); first: index of each document's first word, and the count at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, of: np.ndarray = _IN_WORD):
        self.data, self.offsets = data, offsets
        inside = of[data]
        if len(data):
            before = np.empty_like(inside)
            before[0], before[1:] = False, inside[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            after[offsets[1:][offsets[1:] > 0] - 1] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word; fold: A-Z count as a-z."""
        n = len(self.data)
        up, down = _powers("byte", n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_CODE_FOLDED if fold else _BYTE_CODE)[self.data] * up[:n], out=sums[1:])
        out = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        # sums of 1,024 terms and more can agree by the structure of the words, whatever the base
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest(), "little")
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, documents' borders ignored: len(word_hashes) - k + 1 of them."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers("word", n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1], 0x5851F42D4C957F2D + k)


def whole(word_hashes: np.ndarray) -> int:
    """Hash of a short sequence as a whole, apart from windows of other lengths."""
    return int(windows(word_hashes, len(word_hashes))[0])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = np.minimum(out[: len(out) - step], out[step:])
    return out

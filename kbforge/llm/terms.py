"""Terms of text columns as exact byte strings: runs of bytes of a class, lower-cased in A-Z, made by vector operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kbforge.llm import kernel

#: Bytes of [0-9A-Za-z] and of all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: The same as a pattern of a term, for text whose A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Terms:
    """Terms of consecutive rows: starts and ends (byte places), first (each row's first term, and the count at the end), values (their bytes, lower-cased)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, of: np.ndarray = ALNUM):
        found = kernel.Words(data, offsets, of)
        self.starts, self.ends, self.first = found.starts, found.ends, found.first
        sizes = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=sizes[1:])
        body = kernel._FOLD[data[of[data]]]
        self.values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(body.tobytes())])


def slices(column: pa.Array, of: np.ndarray = ALNUM, limit: int = kernel.SLICE_BYTES):
    """(first row, row after the last, bytes, offsets, terms) of consecutive rows. A null is empty."""
    for a, b, data, offsets in kernel.slices(column, limit):
        yield a, b, data, offsets, Terms(data, offsets, of)


def of_text(text: str | None, of: np.ndarray = ALNUM) -> list[bytes]:
    """The terms of one short text."""
    return next(slices(pa.array([text or ""]), of))[4].values.to_pylist()


def sql_terms(text: str) -> str:
    """DuckDB SQL for the list of terms of a text."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{PATTERN}')"

"""Token ids of whole texts by the tokenizers library, remembered per piece of text.

A byte-level BPE encodes each pre-token by itself, and a single space between two other characters always starts a
pre-token. So a text falls apart at its single spaces, and a piece seen before need not be encoded again: the ids of a text are
the remembered ids of its pieces. Slices of texts are split and their distinct pieces found by Arrow, so that the cost of a
piece that comes again is a gather. Texts in which a space touches other white space, with an added token's string, or with
characters outside the oldest ranges of Unicode, are encoded in one call each.
Pieces are encoded by the library's own BPE model, behind its byte alphabet, each pre-token of the piece separately.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from kbforge.llm import kernel

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces and pre-tokens that one worker remembers at most (some 200 bytes each); a full memory is begun anew.
PIECES, TOKENS = 1_200_000, 200_000
#: Bytes of text that are taken apart at a time.
SLICE = 1 << 23
#: A letter run and one of these are two pre-tokens.
_CLOSING = frozenset(",.;:!?")
#: White space within the ranges below; outside these, letter tables of different Unicode versions could differ.
_WHITE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]"
_UNSURE = r"[^\x00-\x{52f}\x{2000}-\x{206f}]"


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in prints:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_ALPHABET = "".join(_byte_alphabet())
_readers: dict[tuple[str, str], "Reader"] = {}


class _Store:
    """Id sequences side by side in one array, addressed by slot. New ones wait in a list until the next gather."""

    def __init__(self, dtype: np.dtype):
        self.ids, self.used = np.zeros(1 << 16, dtype), 0
        self.begin, self.count, self.slots = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.new: list[bytes] = []

    def add(self, raw: bytes) -> int:
        self.new.append(raw)
        return self.slots + len(self.new) - 1

    def raw(self, slot: int) -> bytes:
        return self.new[slot - self.slots] if slot >= self.slots else self.ids[self.begin[slot] : self.begin[slot] + self.count[slot]].tobytes()

    def _settle(self) -> None:
        ids = np.frombuffer(b"".join(self.new), self.ids.dtype)
        count = np.fromiter(map(len, self.new), np.int64, len(self.new)) // self.ids.itemsize
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.slots + len(count) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        own = slice(self.slots, self.slots + len(count))
        self.begin[own], self.count[own] = self.used + np.cumsum(count) - count, count
        self.used, self.slots, self.new = self.used + len(ids), self.slots + len(count), []

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slots one after the other, and how many each has."""
        if self.new:
            self._settle()
        n = self.count[slots].astype(np.int64)
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.begin[slots] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


class Reader:
    def __init__(self, tokenizer_path: str, pattern: str):
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            self.tokenizer = Tokenizer.from_str(text := f.read())
        spec = json.loads(text)
        self.dtype, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        # pieces may be taken apart only where pre-tokens are split by the pattern and nothing else changes the text
        pre = spec.get("pre_tokenizer") or {}
        self.separable = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE"
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or ()]
        self.whole = "|".join([_UNSURE, _WHITE + " ", " " + _WHITE, *added])
        self.pattern = regex.compile(pattern)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.store = _Store(self.dtype)
        self.pieces: dict[str, int] = {}  # behind a space
        self.openings: dict[str, int] = {}  # at a text's start
        self.tokens: dict[str, bytes] = {}

    def _bpe(self, word: str) -> bytes:
        """Ids of one pre-token."""
        shown = codecs.charmap_decode(word.encode(), "strict", _ALPHABET)[0]
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _token(self, word: str) -> bytes:
        found = self.tokens.get(word)
        if found is None:
            found = self._bpe(word)
            if len(self.tokens) < TOKENS:
                self.tokens[word] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a run of letters behind a space."""
        at = self.pieces.get(word)
        if at is not None:
            return self.store.raw(at)
        return array(self.code, [t.id for t in self.model.tokenize(_ALPHABET[32] + word)]).tobytes() if word.isascii() else self._bpe(" " + word)

    def _encoded(self, piece: str) -> bytes:
        """Ids of a piece behind a space that isn't a run of letters."""
        if piece[-1:] in _CLOSING and piece[:-1].isalpha():
            return self._word(piece[:-1]) + self._token(piece[-1])
        return b"".join(map(self._token, self.pattern.findall(" " + piece)))

    def _opening(self, piece: str) -> int:
        at = self.openings.get(piece)
        if at is None:
            self.openings[piece] = at = self.store.add(b"".join(map(self._token, self.pattern.findall(piece))))
        return at

    def _taken_apart(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy()[:-1]
        pieces = split.values
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        if len(self.pieces) + len(self.openings) + len(names) > PIECES:
            self._forget()
        slots = list(map(self.pieces.get, names))
        known, code, tokenize, space = self.pieces, self.code, self.model.tokenize, _ALPHABET[32]
        shown = codecs.charmap_decode
        new, settled = self.store.new, self.store.slots
        for i, x in enumerate(slots):
            if x is None:
                piece = names[i]
                if piece.isalpha():
                    # such a run of letters is a pre-token with the space before it
                    word = space + (piece if piece.isascii() else shown(piece.encode(), "strict", _ALPHABET)[0])
                    found = array(code, [t.id for t in tokenize(word)]).tobytes()
                else:
                    found = self._encoded(piece)
                slots[i] = known[piece] = settled + len(new)
                new.append(found)
        of = np.array(slots, np.int64)[coded.indices.to_numpy()]
        of[first] = [self._opening(p) for p in pieces.take(pa.array(first)).to_pylist()]
        ids, n = self.store.gather(of)
        return ids, np.add.reduceat(n, first)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.separable:
            whole = np.ones(len(texts), bool)
        else:
            whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._taken_apart(texts)
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        if not whole.all():
            ids, n = self._taken_apart(texts.filter(pa.array(~whole)))
            for i, part in zip(np.flatnonzero(~whole).tolist(), np.split(ids, np.cumsum(n)[:-1])):
                out[i] = part
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def slices(self, texts: pa.Array):
        """(first row, row after the last, ids, ends of each row's ids) of consecutive rows of about SLICE bytes. A null is empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        for a, b, _, _ in kernel.slices(texts, SLICE):
            ids, n = self._slice(texts.slice(a, b - a))
            yield a, b, ids, np.cumsum(n)

    def ids(self, text: str) -> np.ndarray:
        return next(self.slices(pa.array([text])))[2]


def reader(tokenizer_path: str, pattern: str) -> Reader:
    """One per worker process."""
    key = (tokenizer_path, pattern)
    if key not in _readers:
        _readers[key] = Reader(*key)
    return _readers[key]


def forget() -> None:
    """Drops what the readers of this process remember: a worker that goes on to other work keeps no more than it needs."""
    for r in _readers.values():
        r._forget()
    kernel.release()

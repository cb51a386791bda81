"""Character sets of fetched bodies, found from their bytes, and their text.

A byte order mark decides; so does a body that is valid UTF-8. Otherwise the candidates decode the body, and each text is rated by what its
characters outside ASCII are: how many are ones that running text of that language is made of, how they stand among ASCII letters, how many
bytes could not be decoded. A word counts once, however often it comes: a title, a menu entry or a short word that is
repeated says no more. What the response or the page declares is a candidate with a small advance, for declarations are often wrong.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks at a body's start, longest first (fixed values).
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Declared names that mean a larger set in practice (fixed values).
WIDER = {"gb2312": "gb18030", "gbk": "gb18030", "hz": "gb18030", "iso8859-1": "cp1252", "ascii": "cp1252", "latin-1": "cp1252", "iso8859-9": "cp1254", "euc_kr": "cp949", "big5": "big5hkscs"}
CHINESE, JAPANESE, LATIN, CYRILLIC = ("gb18030", "big5hkscs"), ("euc_jp", "cp932"), ("cp1252", "cp1250"), ("cp1251", "koi8_r")
CANDIDATES = (*CHINESE, *JAPANESE, "cp949", *LATIN, *CYRILLIC)
#: What a declaration counts for, and each undecodable byte against, in shares of the characters outside ASCII.
DECLARED, BROKEN = 0.15, 3.0
#: What a Cyrillic letter within a word of ASCII letters counts against.
MIXED = 1.5
_META = re.compile(rb"<meta[^>]{0,300}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)|<\?xml[^>]{0,200}?encoding\s*=\s*[\"']([A-Za-z0-9_.:-]+)", re.I)
_HEADER = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def known(name: str | None) -> str | None:
    """Python's name of a declared character set, widened as browsers do; None if there is none."""
    try:
        found = codecs.lookup((name or "").strip()).name
        "a".encode(found)  # codecs that make no text are refused
    except (LookupError, ValueError):
        return None
    return WIDER.get(found, found)


def _of_rows(codec: str, leads: range, trails: tuple[range, ...]) -> np.ndarray:
    """A table over the basic plane: characters that the code rows hold."""
    table = np.zeros(1 << 16, bool)
    for lead in leads:
        for trail in (t for r in trails for t in r):
            try:
                table[ord(bytes((lead, trail)).decode(codec))] = True
            except (UnicodeDecodeError, TypeError):
                continue
    return table


@lru_cache(maxsize=1)
def _common() -> dict[str, np.ndarray]:
    """Characters of running text: the frequent rows of the national sets, which order their characters by use."""
    high = range(0xA1, 0xFF)
    out = {"gb18030": _of_rows("gb2312", range(0xB0, 0xD8), (high,)), "big5hkscs": _of_rows("big5", range(0xA4, 0xC7), (range(0x40, 0x7F), high))}
    japanese = _of_rows("euc_jp", range(0xB0, 0xD0), (high,)) | _of_rows("euc_jp", range(0xA4, 0xA6), (high,))
    out |= {"euc_jp": japanese, "cp932": japanese, "cp949": _of_rows("euc_kr", range(0xB0, 0xC9), (high,))}
    marks = np.zeros(1 << 16, bool)
    marks[0x3000:0x3020] = marks[0xFF01:0xFF60] = marks[0x2010:0x2027] = True
    return {k: v | marks for k, v in out.items()}


_BREAK = re.compile(r"[^\W\d_a-zA-Z]+")
_ASCII = re.compile("[A-Za-z]")
#: Words with a character outside ASCII: letters, and all that is outside ASCII, up to the next other one.
_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]*[^\x00-\x7F][A-Za-z\x80-\U0010FFFF]*")


def _case_breaks(text: str) -> int:
    """Capitals behind small letters within words outside ASCII: what a wrong set of letters has many of."""
    return sum(a.islower() and b.isupper() for word in _BREAK.findall(text) for a, b in zip(word, word[1:]))


def _rating(codec: str, text: str) -> float:
    """How much a text looks like running text of the codec's languages, 1 at best. Its different words are rated."""
    words = list(dict.fromkeys(_WORD.findall(text)))
    text = " ".join(words)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    wide = c >= 0x80
    n = int(wide.sum())
    if not n:
        return 0.0
    broken = int((c == 0xFFFD).sum()) / n
    own = c[wide]
    letter = ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128)
    near = np.zeros(len(c), bool)
    near[1:] |= letter[:-1]
    near[:-1] |= letter[1:]
    if codec in CYRILLIC:
        lower = (own >= 0x430) & (own <= 0x44F) | (own == 0x451)
        upper = (own >= 0x410) & (own <= 0x42F)
        mixed = sum(sum(x > "\x7f" for x in w) for w in words if _ASCII.search(w)) / n
        score = (lower.sum() + 0.5 * min(int(upper.sum()), int(lower.sum()) // 2)) / n - MIXED * mixed - _case_breaks(text) / n
    elif codec in LATIN:
        apart = np.ones(len(c), bool)  # letters with accents stand among plain ones, seldom next to each other
        apart[1:] &= ~wide[:-1]
        apart[:-1] &= ~wide[1:]
        good = (own >= 0xC0) & (own <= 0x17F) & (own != 0xD7) & (own != 0xF7) | (own >= 0x2013) & (own <= 0x2026) | (own == 0x20AC) | np.isin(own, (0xA0, 0xA3, 0xA7, 0xA9, 0xAB, 0xB0, 0xB7, 0xBB, 0xBF, 0xA1))
        score = 0.9 * (good & apart[wide]).mean() + 0.05 * near[wide].mean() - (0.03 if codec != "cp1252" else 0.0)
    elif codec not in CANDIDATES:  # declared sets of other scripts
        score = sum(map(str.isalpha, text)) / max(1, sum(x > "\x7f" or x.isalpha() for x in text)) - near[wide].mean() - _case_breaks(text) / n
    else:
        basic = own[own < 1 << 16]
        score = _common()[codec][basic].sum() / n - 0.5 * near[wide].mean()
        if codec in JAPANESE:
            score *= min(1.0, 5 * float(((own >= 0x3041) & (own <= 0x30FF)).mean()))
        if codec == "cp949":  # the rows of Korean syllables are rows of Chinese characters elsewhere
            score = score * (1.02 if ((own >= 0xAC00) & (own <= 0xD7A3)).mean() > 0.9 or score > 0.97 else 0.5)
    return float(score) - BROKEN * broken


def detect(body: bytes, content_type: str | None = None) -> str:
    """The character set of a body, by Python's name."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return name
    if body.isascii() and b"\x00" not in body:
        return "iso2022_jp" if b"\x1b$" in body else "utf-8"
    if b"\x00" in body and len(body) % 2 == 0:
        zeros = np.frombuffer(body, np.uint8) == 0
        even, odd = zeros[::2].mean(), zeros[1::2].mean()
        if max(even, odd) > 0.3 and min(even, odd) < 0.05:
            return "utf-16-le" if odd > even else "utf-16-be"
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(body)  # a character cut at the end is no fault
        return "utf-8"
    except UnicodeDecodeError:
        pass
    meta = _META.search(body)
    header = _HEADER.search(content_type or "")
    declared = {known(header[1] if header else None), known(next(g for g in meta.groups() if g).decode("ascii") if meta else None)} - {None}
    rated = []
    for k, name in enumerate(dict.fromkeys((*CANDIDATES, "utf-8", *sorted(declared)))):
        text = body.decode(name, "replace")
        rated.append((_rating(name if name != "utf-8" else "cp1252", text) + DECLARED * (name in declared), -k, name))
    return max(rated)[2]


def decode(body: bytes | None, content_type: str | None = None) -> tuple[str | None, str | None]:
    """Text and character set; what can't be decoded becomes U+FFFD. Nulls for a null body."""
    if body is None:
        return None, None
    name = detect(bytes(body), content_type)
    return bytes(body).decode(name, "replace"), name


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(b, t) for b, t in zip(body, content_type)], columns=["text", "charset"])

"""Keyword tables against texts: which of many words a text contains, by an Aho-Corasick automaton.

The words are built into automata of at most BLOCK_CHARS characters, which go to the workers once; a table of any size takes more than one of
them, and every text passes through each. Texts run through in Arrow batches, in time of their length and hits, whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of keywords in one automaton (some 100 bytes of memory each).
BLOCK_CHARS = 1 << 20


def _automata(words: DataFrame, word: str, most: int) -> Iterator[ahocorasick.Automaton]:
    """Automata of the distinct lower-case words, built as they come from the executors a partition at a time."""
    lower = words.select(F.lower(word).alias("w")).where("w <> ''").distinct()
    automaton, size = ahocorasick.Automaton(), 0
    for (w,) in lower.toLocalIterator():
        if size and size + len(w) > most:
            automaton.make_automaton()
            yield automaton
            automaton, size = ahocorasick.Automaton(), 0
        automaton.add_word(w, w)
        size += len(w)
    if size:
        automaton.make_automaton()
        yield automaton


def _matches(shared: Broadcast):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        a = shared.value
        return pd.Series([sorted({w for _, w in a.iter(t)}) if t else [] for t in texts], index=texts.index, dtype=object)

    return run


def contained(words: DataFrame, word: str, text: Column, block_chars: int = BLOCK_CHARS) -> Column:
    """Sorted array of the distinct lower-case words that the lower-case text contains, anywhere in it. Null texts contain none; null and empty words are none."""
    sc = words.sparkSession.sparkContext
    found = [_matches(sc.broadcast(automaton))(F.lower(text)) for automaton in _automata(words, word, block_chars)]
    none = F.array().cast("array<string>")
    out = found[0] if found else none
    for more in found[1:]:
        out = F.array_union(out, more)
    return F.array_sort(out) if len(found) > 1 else out


def useful_link(url: Column, anchor: Column, title: Column, words: DataFrame, word: str = "word", domains: tuple[str, ...] = ()) -> Column:
    """functions.urls.useful_link with a table of keywords."""
    from kbforge.functions import urls

    text = F.concat_ws(" ", url, F.coalesce(anchor, F.lit("")), F.coalesce(title, F.lit("")))
    hit = F.size(contained(words, word, text)) > 0
    return urls.classified(url, domains, hit)

"""Operator 8, quality rules, line first; DataFrame functions only.

Every line that holds a word is judged by itself: by its punctuation, as navigation, and as boilerplate. Failing lines are
removed, then the document is judged by what it lost. Four counts of the whole text give a base verdict beside it.

Null or empty text: all counts 0, no line is kept, base_failed true, kept false, cleaned text ''. Each row is judged by
itself, so ties, repeated rows and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Phrases that make a line boilerplate, in lower case (fixed values).
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "lorem ipsum", "click here", "sign up for our newsletter", "skip to content",
)
#: A phrase makes a line boilerplate if the line has at most so many words: a paragraph may mention one.
BOILERPLATE_LINE = 30
#: A line of fewer words must end as a sentence does.
SHORT_LINE = 4
#: Separators and their share of a line's words that make it navigation.
NAV_MARKS, NAV_SHARE = 2, 0.2
#: Symbols per word that make a line garbage.
SYMBOLS_PER_WORD = 0.5
#: Words all in capitals that make a line shouting.
SHOUT_WORDS = 3
#: A document that keeps less than this share of its words is rejected.
KEEP_SHARE = 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def judged_lines(text: Column) -> Column:
    """Array of structs (line, n, fails) of the lines that hold a word; each measure of a line is taken once."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    measured = F.transform(
        lines,
        lambda x: F.struct(
            x.alias("line"),
            F.lower(x).alias("low"),
            F.size(words(x)).alias("n"),
            (F.length(x) - F.length(F.translate(x, "|»›•", ""))).alias("marks"),
            (F.length(x) - F.length(F.translate(x, "#*$%&<>", ""))).alias("symbols"),
        ),
    )
    return F.transform(measured, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), _fails(x).alias("fails")))


def _fails(x: Column) -> Column:
    line, low, n = x["line"], x["low"], x["n"]
    unended = (n < SHORT_LINE) & ~line.rlike("[.!?:;\"'»”)。！？][\\x20\\x09-\\x0D]*$")
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    boilerplate = (n <= BOILERPLATE_LINE) & boilerplate
    navigation = (x["marks"] >= NAV_MARKS) & (x["marks"] >= NAV_SHARE * n)
    garbage = x["symbols"] >= F.greatest(F.lit(2.0), SYMBOLS_PER_WORD * n)
    shouting = (n >= SHOUT_WORDS) & (line != low) & (line == F.upper(line))
    return navigation | garbage | shouting | unended | boilerplate


def _repeats(n: str, hashes: str, k: int) -> str:
    """SQL: words covered by k-word windows that occur twice or more. The array of hashes is bound once; the sort runs only where a hash repeats."""
    return f"""
    CASE WHEN {n} < {k} + 1 OR size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE
      transform(array(array_sort(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))), s ->
        aggregate(
          array_sort(transform(
            filter(s, (x, j) -> (j > 0 AND get(s, j - 1).h = x.h) OR (j + 1 < size(s) AND get(s, j + 1).h = x.h)), x -> x.i)),
          struct(0L AS covered, -1L AS upto),
          (a, p) -> struct(a.covered + (p + {k}L - greatest(CAST(p AS BIGINT), a.upto)) AS covered, p + {k}L AS upto),
          a -> a.covered))[0] END"""


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once a row: filters and projections above a generator aren't merged into what is below it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def line_first_quality(docs: DataFrame, text: str = "text", keep_share: float = KEEP_SHARE) -> DataFrame:
    """docs with struct column `quality`: counts, base verdict, line counts, kept, and the cleaned text. An input column of that name gives way."""
    own = [c for c in docs.columns if c != "quality"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_q_text"))
    out = _bound(out, "_q_words", words(F.col("_q_text")))
    out = _bound(out, "_q_lines", judged_lines(F.col("_q_text")))
    out = _bound(out, "_q_hash", F.transform("_q_words", lambda w: F.xxhash64(w)))
    n = "size(_q_words)"
    window = ", ".join(f"get(_q_hash, i + {j})" for j in range(5))
    out = _bound(out, "_q_win", F.expr(f"CASE WHEN {n} > 5 THEN transform(sequence(0, {n} - 5), i -> xxhash64({window})) ELSE CAST(array() AS ARRAY<BIGINT>) END"))
    good = F.filter("_q_lines", lambda x: ~x["fails"])
    out = _bound(out, "_q", F.struct(good.alias("good"), F.expr(_repeats(n, "_q_win", 5)).alias("repeat")))
    kept = F.aggregate("_q.good", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    n_words = F.size("_q_words").cast("long")
    base = (n_words < 10) | (100 * F.col("_q.repeat") > 20 * n_words)
    quality = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        (F.length("_q_text") - F.length(F.translate("_q_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines.line"))).cast("long").alias("n_dup_lines"),
        F.col("_q.repeat").alias("n_repeat_words"),
        base.alias("base_failed"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        F.size("_q.good").cast("long").alias("n_good_lines"),
        kept.alias("n_kept_words"),
        (~base & (kept >= keep_share * n_words)).alias("kept"),
        F.array_join("_q.good.line", "\n").alias("cleaned"),
    )
    return _bound(out, "_q_quality", quality).select(*[F.col("_row")[c].alias(c) for c in own], F.col("_q_quality").alias("quality"))


def op8(docs: DataFrame) -> DataFrame:
    q = line_first_quality(docs.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_good_lines", "n_kept_words")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names])


_SQL_BAD = r"""((len(w) < 4 AND NOT regexp_matches(l, '[.!?:;"''»”)。！？][\x20\x09-\x0D]*$'))
 OR (m >= 2 AND m >= 0.2 * len(w)) OR (s >= greatest(2.0, 0.5 * len(w)))
 OR (len(w) >= 3 AND l = upper(l) AND l <> lower(l))
 OR (len(w) <= 30 AND (""" + " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE) + ")))"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
ln AS (SELECT doc_id, l, list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
              length(l) - length(regexp_replace(l, '[|»›•]', '', 'g')) AS m, length(l) - length(regexp_replace(l, '[#*$%&<>]', '', 'g')) AS s
       FROM (SELECT doc_id, unnest(ls) AS l FROM w)),
lk AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT bad) AS n_good_lines, coalesce(sum(nw) FILTER (NOT bad), 0)::BIGINT AS n_kept_words, count(DISTINCT l) AS n_distinct
       FROM (SELECT doc_id, l, len(w) AS nw, {_SQL_BAD} AS bad FROM ln) GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_good_lines, 0)::BIGINT AS n_good_lines, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lk USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND n_kept_words >= 0.5 * n_words AS kept FROM b"""

"""Text columns: whitespace as Python sees it, hashes, question and record forms. All are plain SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that str.isspace accepts; Java's Unicode \\s lacks U+001C..U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"

#: Names under which question and answer are looked for, in this order.
QUESTION_KEYS = ("question", "query", "q", "instruction", "prompt", "input", "title")
ANSWER_KEYS = ("answer", "response", "a", "output", "completion", "content")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"{SPACE}+", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def make_id(c: Column) -> Column:
    return F.md5(F.encode(c.cast("string"), "UTF-8"))


def content_hash(c: Column, prefix: int = 12000) -> Column:
    """The first `prefix` characters of the squashed text decide; 8000 in the base variant."""
    return make_id(F.substring(squash(F.coalesce(c, F.lit(""))), 1, prefix))


def question_norm(c: Column) -> Column:
    return F.translate(squash(c), "？", "?")


def question_id(stored: Column, question: Column) -> Column:
    """A stored id wins over the hash of the normalized question."""
    return F.coalesce(F.nullif(stored, F.lit("")), make_id(question_norm(question)))


def shorten(c: Column, n: int = 300) -> Column:
    flat = strip(F.translate(c, "\n", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def pick_first(*candidates: Column) -> Column:
    """The first value that is not blank, stripped; '' if there is none."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in candidates], F.lit(""))


def index_text(question: Column, answer: Column) -> Column:
    return strip(F.concat(F.lit("问题："), question, F.lit("\n答案："), answer))


def labelled(label: str, value: Column) -> Column:
    """`label` and the stripped value, null if it is blank."""
    v = strip(F.coalesce(value, F.lit("")))
    return F.when(v != "", F.concat(F.lit(label), v))


def _body(question: Column, answer: Column, fallback: Column) -> Column:
    q, a = strip(F.coalesce(question, F.lit(""))), strip(F.coalesce(answer, F.lit("")))
    block = F.concat(F.lit("问题："), q, F.lit("\n答案："), a)
    return F.when((q == "") & (a == ""), strip(F.coalesce(fallback, F.lit("")))).otherwise(block)


def rerank_doc_text(question: Column, answer: Column, fallback: Column, category: Column, title: Column, url: Column) -> Column:
    """What a cross-encoder reads: the pair, then category, source title and link where they are given."""
    return F.concat_ws("\n", _body(question, answer, fallback), labelled("类别：", category), labelled("来源标题：", title), labelled("来源链接：", url))


def query_prefix(task: Column | str, query: Column) -> Column:
    task = F.lit(task) if isinstance(task, str) else task
    return F.concat(F.lit("Instruct: "), task, F.lit("\nQuery:"), query)


def clean_lines(c: Column, least: int) -> Column:
    """Array of lines with white space collapsed, those of at least `least` characters."""
    return F.filter(F.transform(F.split(c, "\n", -1), collapse), lambda x: F.length(x) >= least)


def collapse_runs(lines: Column) -> Column:
    """Array without the elements that equal the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1) != x))


def json_clean(c: Column, braces: bool = False) -> Column:
    """A model's reply without its code fence; braces: of a reply that does not begin with one, what lies between the outermost."""
    out = strip(F.coalesce(c, F.lit("")))
    for fence in ("^```json", "^```", "```$"):
        out = strip(F.regexp_replace(out, fence, ""))
    if not braces:
        return out
    cut = F.regexp_extract(out, r"(?s)\{.*\}", 0)
    return F.when(out.startswith("{") | (cut == ""), out).otherwise(cut)


def last_segment(url: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(url, "/", -1), -1), F.lit("")), F.lit(default))


def evidence(given: Column, chunk: Column) -> Column:
    e = strip(F.coalesce(given, F.lit("")))
    return F.when(e == "", F.substring(chunk, 1, 250)).otherwise(F.substring(e, 1, 500))

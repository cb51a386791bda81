"""Operator 7, personal data by bootstrapped contextual extraction; DataFrame functions only.

Base entities (email, ip, card, phone) are found by their form. They, and long hexadecimal strings as seeds of the kind
`secret`, seed a graph of patterns and instances: an instance is an identifier-like token (a word with a digit or an @, or digit
groups with single spaces between them), a pattern the two words before it with the token's shape. The words before a word are
whole; before digit groups they are looked for within GROUP_CONTEXT code points. Spark scores the graph in rounds: a pattern is as sure as the share
of its distinct instances that are trusted, an instance as sure as its patterns make it (noisy or). Patterns
above CONFIDENT with SUPPORT instances then give their kind to the tokens that no form had found.

Null or empty text: no spans. A null doc_id is a value like any other. Repeated rows give equal results and count once in the graph. Overlapping kinds are all
reported. Other columns are ignored by `find`; `redact` keeps them. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.llm import skew
from kbforge.llm.scratch import written

KINDS = ("email", "ip", "card", "phone", "secret")
#: Possessive forms of the base patterns: same matches, no backtracking, no recursion on long runs.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Digit groups with single spaces between them, as phones and cards are written.
GROUPED = r"(?<![^\x20\x09-\x0D])[+(]?+[0-9][0-9().-]*+(?:\x20[0-9().-]++)++"
GROUP_CONTEXT = 256
#: Rounds over the graph, what a pattern must score, and how many distinct instances it must have.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.6, 5
#: Added to a pattern's instances when its share of trusted ones is taken.
SMOOTH = 1.0
#: Hexadecimal strings of this length or more, with letters and digits, are seeds of the kind secret.
SECRET_SEED = 32

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str) -> Column:
    """Array of (value, start, end) of the leftmost non-overlapping matches, in code points. The text splits into the gaps between
    matches; starts are running sums of lengths, taken in blocks so that the work stays near linear."""

    def sums(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.slice(z, b * _BLOCK + 1, _BLOCK))
        return let(blocks, lambda bs: let(heads(bs), lambda h: F.flatten(F.transform(bs, lambda block, i: inside(block, F.get(h, i))))))

    def heads(bs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("out"))
        total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["n"])
        return F.aggregate(bs, start, lambda a, block: F.struct((a["at"] + total(block)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def inside(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.expr("CAST(array() AS array<struct<value:string,start:bigint,end:bigint>>)").alias("out"))
        one = lambda a, x: F.struct(x["m"].alias("value"), (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"))
        return F.aggregate(block, start, lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(one(a, x))).alias("out")), lambda a: a["out"])

    def spans(x: Column) -> Column:
        measured = F.zip_with(x["m"], F.slice(x["p"], F.lit(1), F.size(x["m"])), lambda m, p: F.struct(m.alias("m"), F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("n")))
        empty = F.expr("CAST(array() AS array<struct<value:string,start:bigint,end:bigint>>)")
        return F.when(F.size(x["m"]) == 0, empty).otherwise(let(measured, sums))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) == 0, F.expr("CAST(array() AS array<struct<value:string,start:bigint,end:bigint>>)")).otherwise(
        let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p")), spans)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.get(doubled, digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(located(text, FORMS[kind]), lambda s: _holds(kind, s["value"]))
    found = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    can = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
    return F.when(can, found).otherwise(F.expr(f"CAST(array() AS {_SPAN})"))


def _tokens(text: Column) -> Column:
    """Array of identifier-like tokens without their outer punctuation: core, its place, its shape, the two words before."""

    def two_words(left: Column) -> Column:
        return F.regexp_replace(F.lower(left), r"[0-9]+", "0")

    def one(s: Column, left: Column) -> Column:
        head = F.length(F.regexp_extract(s["value"], r"^[^\p{L}0-9+]*", 0)).cast("long")
        core = F.regexp_extract(s["value"], r"^[^\p{L}0-9+]*(.*?)[^\p{L}0-9]*$", 1)
        return F.struct(core.alias("core"), (s["start"] + head).alias("start"), two_words(left).alias("left"))

    # TOKEN finds exactly the words with a digit or an @: the n-th match is the n-th of these words
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")
    before = lambda ws: F.filter(
        F.transform(ws, lambda w, i: F.when(w.rlike("[0-9@]"), F.when(i >= 2, F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1))).otherwise(F.lit("")))), lambda x: x.isNotNull()
    )
    plain = let(words, lambda ws: F.zip_with(located(text, TOKEN), before(ws), one))

    def spaced_left(s: Column) -> Column:
        near = F.substring(text, F.greatest(s["start"] - (GROUP_CONTEXT - 1), F.lit(1)).cast("int"), F.least(s["start"], F.lit(GROUP_CONTEXT)).cast("int"))
        return F.regexp_replace(F.regexp_extract(near, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$", 1), r"[\x20\x09-\x0D]+", " ")

    none = F.expr("CAST(array() AS array<struct<core:string,start:bigint,left:string>>)")
    spaced = F.when(text.rlike(r"[0-9)] [(0-9]"), F.transform(located(text, GROUPED), lambda s: one(s, spaced_left(s)))).otherwise(none)

    def shaped(t: Column) -> Column:
        core = t["core"]
        shape = (
            F.when(core.contains("@"), "mail")
            .when(core.rlike("^[0-9a-fA-F]{16,}$") & core.rlike("[a-fA-F]") & core.rlike("[0-9]"), "hex")
            .when(core.rlike("^[0-9]+$"), F.concat(F.lit("number"), F.length(core).cast("string")))
            .when(core.rlike("^[0-9.]+$"), "dotted")
            .when(core.rlike("^[0-9 ()+.-]+$"), "grouped")
            .otherwise(F.concat(F.lit("mixed"), F.least(F.floor(F.length(core) / 8), F.lit(4)).cast("string")))
        )
        return F.struct(core.alias("core"), t["start"].alias("start"), (t["start"] + F.length(core)).alias("end"), t["left"].alias("left"), shape.alias("shape"))

    some = F.filter(F.transform(F.concat(plain, spaced), shaped), lambda t: (F.length(t["core"]) >= 4) & (t["left"] != ""))
    return F.when(text.rlike("[0-9@]"), some).otherwise(F.expr("CAST(array() AS array<struct<core:string,start:bigint,end:bigint,left:string,shape:string>>)"))


def confident_patterns(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows tokens(core, left, shape) and seeds(core, kind) to rows (left, shape, kind, confidence): graph scores in ROUNDS rounds."""
    edges = written(tokens.select("core", "left", "shape").distinct(), "pii-edges")
    size = edges.groupBy("left", "shape").agg(F.count("*").alias("size")).where(F.col("size") >= SUPPORT)
    kept = written(skew.spread_join(edges, size, ["left", "shape"], ["core"]), "pii-kept")
    trust = seeds.select("core", "kind").distinct().withColumn("trust", F.lit(1.0))
    known = trust
    scores = None
    for round_ in range(ROUNDS):
        scores = skew.spread_join(kept, trust, ["core"], ["left", "shape"]).groupBy("left", "shape", "kind").agg((F.sum("trust") / (F.max("size") + SMOOTH)).alias("confidence")).where("confidence > 0.1")
        if round_ + 1 == ROUNDS:
            break
        by_pattern = skew.spread_join(kept, scores, ["left", "shape"], ["core"]).groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("trust"))
        trust = by_pattern.unionByName(known).groupBy("core", "kind").agg(F.max("trust").alias("trust"))
    best = scores.where(F.col("confidence") >= CONFIDENT).groupBy("left", "shape").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    return best.select("left", "shape", "b.kind", "b.confidence")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, base, added): arrays of spans (kind, start, end, value), start and end in code points. doc_id and text together tell rows apart."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = F.concat(*[base_spans(F.col("text"), k) for k in FORMS])
    found = written(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), base.alias("base"), _tokens(F.col("text")).alias("tokens")), "pii-found")
    tokens = found.where("size(tokens) > 0").select("doc_id", "text_hash", F.explode("tokens").alias("t")).select("doc_id", "text_hash", "t.*")
    by_form = found.where("size(base) > 0").select(F.explode("base").alias("s")).select(F.col("s.value").alias("core"), "s.kind")
    long_hex = tokens.where((F.col("shape") == "hex") & (F.length("core") >= SECRET_SEED)).select("core", F.lit("secret").alias("kind"))
    patterns = written(confident_patterns(tokens, by_form.unionByName(long_hex)), "pii-patterns")
    hits = skew.spread_join(tokens, patterns, ["left", "shape"], ["core"]).select("doc_id", "text_hash", F.struct("kind", "start", "end", F.col("core").alias("value")).alias("s"))
    hits = hits.distinct().groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("s")).alias("hits"))
    hits = hits.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    out = found.select("doc_id", "text_hash", "base").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    free = F.filter("hits", lambda h: ~F.exists("base", lambda b: (h["start"] < b["end"]) & (b["start"] < h["end"])))
    return out.select("doc_id", "text_hash", "base", F.coalesce(free, F.expr(f"CAST(array() AS {_SPAN})")).alias("added"))


def _listed(spans: Column) -> Column:
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans are replaced by the first one's kind."""
    spans = find(docs, text)
    spans = spans.where("size(base) + size(added) > 0").select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_hash"), F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("_spans"))
    spans = spans.dropDuplicates(["_doc_id", "_hash"])
    t = F.col("_text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col(text).alias("_text"))
    joined = rows.join(spans, F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("_text") == F.col("_hash")), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
    )
    rest = lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t)))
    clean = F.when(F.col("_spans").isNull(), t).otherwise(F.aggregate("_spans", start, step, rest))
    return joined.select(*[clean.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select(
        "doc_id", *[count(k) for k in FORMS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added")
    )

"""Operator 13, Merkle manifest of a dataset: leaves, subroots by group, one root, and a proof of every row.

Each row is a leaf. Within its group (a source) leaves stand in ascending order, and on every level `fanout` consecutive nodes become
their parent, until one node is left, the subroot; the subroots give the root in the same way. A level is one grouped DataFrame of sorted
child arrays, a sixteenth of the level below. Proofs come back down the levels: each join appends the siblings of a run to what stands
above it, so that only the last join meets as many rows as there are documents, and a proof is never stored a row.

Places in a group are row numbers. A group may hold any share of the rows, so it isn't numbered in one window: rows are dealt by range over
(group, order, leaf), numbered within their part, and the parts' counts are summed. Nothing is collected but the height of the tree.

Null fields count as `-`. Null groups are a group of their own, before all others; null orders stand first; rows with the same order stand
by their leaf, equal rows next to each other, each with its own place and proof. Empty texts are values of no bytes. An empty table gives
an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm.scratch import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id that count within a partition.
_WITHIN = 33


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*values), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields, each as byte count, colon and value, `-` if null."""
    shown = [c.cast("string") for c in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown])


def _group_key(group: Column) -> Column:
    """The group as a string that is never null and sorts as the group does, nulls first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows(_key, ...) with _idx, the place from 0 within their _key by `order`, and _n, the rows of the key. Written before, rows may be read twice."""
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may fill more than one part
    dealt = rows.repartitionByRange("_key", *[F.col(c).asc_nulls_first() for c in order], "_tie").sortWithinPartitions("_key", *[F.col(c).asc_nulls_first() for c in order], "_tie")
    placed = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", _WITHIN)), label)
    # one row for each key in each part: no more than keys and parts together
    parts = placed.groupBy("_key", "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    by_key = Window.partitionBy("_key")
    before = F.sum("_rows").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    parts = parts.select("_key", "_part", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(by_key).alias("_n"))
    return placed.join(parts, ["_key", "_part"]).withColumn("_idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _runs(nodes: DataFrame, fanout: int, label: str, *more: str) -> DataFrame:
    """Nodes (_key, _n, _idx, hash, ...) to one row a run: its members in order, and the hash of what stands above."""
    member = F.struct("_idx", "hash", *more)
    run = F.floor(F.col("_idx") / fanout).cast("bigint")
    runs = nodes.groupBy("_key", "_n", run.alias("_run")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    hashes = F.transform("members", lambda m: m["hash"])
    # a lone node is the top of its tree and rises as it is
    return written(runs.withColumn("hash", F.when(F.col("_n") > 1, F.sha2(F.concat_ws("", hashes), 256)).otherwise(hashes[0])), label)


def _above(runs: DataFrame, fanout: int) -> DataFrame:
    return runs.select("_key", F.ceil(F.col("_n") / fanout).cast("bigint").alias("_n"), F.col("_run").alias("_idx"), "hash")


def _levels(leaves: DataFrame, fanout: int, label: str, *more: str) -> list[DataFrame]:
    """The runs of each level, bottom up, until every tree has one node: one level at least."""
    out, nodes = [], leaves
    while True:
        out.append(_runs(nodes, fanout, f"{label}-{len(out)}", *(more if not out else ())))
        nodes = _above(out[-1], fanout)
        if (nodes.agg(F.max("_n")).first()[0] or 1) <= 1:
            return out


def _below(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """The members of runs with their own way up: paths(_key, _idx, path, ...) are those of the runs."""
    at = F.col("_run") == F.col("_idx")
    joined = runs.drop("hash").withColumnRenamed("_key", "_k").join(paths, (F.col("_k") == F.col("_key")) & at).drop("_k", "_idx")
    some = joined.withColumn("_hashes", F.transform("members", lambda m: m["hash"]))
    some = some.select("*", F.posexplode("members").alias("_pos", "_member")).drop("members")
    left = F.concat_ws("", F.slice("_hashes", F.lit(1), F.col("_pos")))
    right = F.concat_ws("", F.slice("_hashes", F.col("_pos") + 2, F.size("_hashes")))
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return some.withColumn("path", F.when(F.col("_n") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))).withColumn("_idx", F.col("_member._idx")).drop("_run", "_n", "_pos", "_hashes")


def manifest(docs: DataFrame, leaf_hash: Column, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Rows (order, leaf, subroot, root, path array<struct<left, right>>, and the columns of `keep`) of every row of docs. path holds the
    concatenated siblings on the left and right of each level, from the leaf up to the root."""
    if fanout < 2:
        raise ValueError("fanout must be 2 at least")
    keep = keep or {}
    rows = written(docs.select(_group_key(F.col(group)).alias("_key"), F.col(order).alias("_order"), leaf_hash.alias("hash"), *[c.alias(f"_keep_{k}") for k, c in keep.items()]), "merkle-leaves")
    carried = ["_order", *[f"_keep_{k}" for k in keep]]
    trees = _levels(numbered(rows, ["_order", "hash"], "merkle-placed"), fanout, "merkle-level", *carried)
    subroots = _above(trees[-1], fanout).select(F.col("_key").alias("_tree"), "hash")
    tops = _levels(numbered(subroots.select(F.lit("").alias("_key"), "_tree", "hash"), ["_tree"], "merkle-subroots"), fanout, "merkle-top", "_tree")
    path = F.array().cast("array<struct<left:string,right:string>>")
    paths = _above(tops[-1], fanout).select("_key", "_idx", path.alias("path"), F.col("hash").alias("root"))
    for runs in reversed(tops):
        paths = _below(runs, paths)
        last, paths = paths, paths.drop("_member")
    paths = last.select(F.col("_member._tree").alias("_key"), F.lit(0).cast("bigint").alias("_idx"), "path", "root", F.col("_member.hash").alias("subroot"))
    for runs in reversed(trees):
        paths = _below(runs, paths)
        last, paths = paths, paths.drop("_member")
    m = F.col("_member")
    return last.select(m["_order"].alias(order), m["hash"].alias("leaf"), "subroot", "root", "path", *[m[f"_keep_{k}"].alias(k) for k in keep])


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))), 256)


def folded(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of a path."""
    return F.aggregate(path, leaf_hash, lambda up, x: digest(x["left"], up, x["right"]))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against rows of which every fifth (by crc32 of doc_id) was tampered with."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = F.when(touched, leaf([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]))
    rows = manifest(docs, leaf([F.col(c) for c in FIELDS]), keep={"tampered": other})
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 7) -> str:
    """DuckDB SQL: the levels spelt out, enough of them for 16**levels rows a source and as many sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END), 4294967295)"
    )
    head = lambda t: "sha256(" + " || ".join(field(c) if c != "text" else field(t) for c in FIELDS) + ")"
    out = [
        f"d AS (SELECT doc_id, source, {head('text')} AS h, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 5 = 0 THEN {head(low)} ELSE {head('text')} END AS t FROM documents)",
        "l0 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, h))",
    ]
    above = lambda a, b, by: f"{b} AS (SELECT {by} i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {a} GROUP BY {by} i // 16, n)"
    out += [above(f"l{k}", f"l{k + 1}", "source,") for k in range(levels)]
    out.append(f"r0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{levels})")
    out += [above(f"r{k}", f"r{k + 1}", "") for k in range(levels)]
    side = lambda a, by: f"SELECT {by} i, n, coalesce(string_agg(h, '') OVER (PARTITION BY {by} i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY {by} i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}"
    out += [f"s{k} AS ({side(f'l{k}', 'source,')})" for k in range(levels)] + [f"q{k} AS ({side(f'r{k}', '')})" for k in range(levels)]
    last, proof = "f0 AS (SELECT doc_id, source, i, r0.i AS j, l0.h AS leaf, r0.h AS subroot, t AS f, '' AS p FROM l0 JOIN r0 ON l0.source IS NOT DISTINCT FROM r0.source)", 0
    last = last.replace("SELECT doc_id, source, i, ", "SELECT doc_id, l0.source, l0.i, ")
    out.append(last)
    for tree, place, same in (("s", "i", "x.source IS NOT DISTINCT FROM f.source AND "), ("q", "j", "")):
        for k in range(levels):
            rest = "i // 16 AS i, j" if place == "i" else "i, j // 16 AS j"
            rest = ", ".join(f"f.{x}" for x in rest.split(", "))
            out.append(
                f"f{proof + 1} AS (SELECT doc_id, f.source, {rest}, leaf, subroot, CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN n > 1 THEN p || l || r ELSE p END AS p "
                f"FROM f{proof} f JOIN {tree}{k} x ON {same}x.i = f.{place})"
            )
            proof += 1
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, r{levels}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r{levels}.h AS verified FROM f{proof}, r{levels}"


ORACLE_SQL = _oracle()

"""Keep-first dedup within a run, against earlier runs, and with an acceptance test; the failure log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the first in the order; of rows that tie there, the least by all columns. A minimum per key, combined before
    the shuffle, so a hot key never gathers in one task."""
    first = rows.groupBy(key).agg(F.min(F.struct(order, *[c for c in rows.columns if c != order])).alias("_first"))
    return first.select(*[F.col("_first")[c].alias(c) for c in rows.columns])


def not_in_history(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(history.select(*keys).distinct(), keys, "left_anti")


def accepted_first(rows: DataFrame, key: str, order: str, accepted: Column, history: DataFrame | None = None) -> DataFrame:
    """rows with `status`. The first accepted row of a key is kept, unless history has the key; a row after it, or under a
    known key, is duplicate_content; a rejected row before it is ai_content_irrelevant."""
    marked = rows.withColumn("_ok", accepted.eqNullSafe(F.lit(True)))
    first = marked.where("_ok").groupBy(key).agg(F.min(order).alias("_first"))
    out = marked.join(first, key, "left")
    known = F.lit(False)
    if history is not None:
        out = out.join(history.select(F.col(key), F.lit(True).alias("_known")).distinct(), key, "left")
        known = F.coalesce("_known", F.lit(False))
    status = F.when(known | (F.col(order) > F.col("_first")), "duplicate_content").when(F.col("_ok"), "kept").otherwise("ai_content_irrelevant")
    return out.select(*rows.columns, status.alias("status"))


def failure_log(failures: DataFrame, order: str, history: DataFrame | None = None) -> DataFrame:
    """The first row of each (url, reason) that history lacks, of ties the least by all columns; rows without a URL go."""
    out = failures.where("url <> ''").groupBy("url", "reason").agg(F.min(F.struct(order, *[c for c in failures.columns if c != order])).alias("_first"))
    out = out.select(*[F.col("_first")[c].alias(c) for c in failures.columns])
    return not_in_history(out, history, ["url", "reason"]) if history is not None else out


def page_cap(rows: DataFrame, order: str, success: Column, cap: int) -> DataFrame:
    """Rows up to the cap-th success in order. The cap-th is found by a top-k over the successes, so no window spans the table."""
    marked = rows.withColumn("_ok", success.eqNullSafe(F.lit(True)))
    hit = marked.where("_ok").select(order).orderBy(order).limit(cap)
    edge = hit.agg(F.max(order).alias("_edge"), F.count("*").alias("_n"))
    return marked.join(F.broadcast(edge), (F.col("_n") < cap) | (F.col(order) <= F.col("_edge"))).select(*rows.columns)


def ordered_union(first: DataFrame, more: DataFrame, value: str, order: str, cap: int) -> DataFrame:
    """Rows (value, ord): first with its own repeats, then what more adds, at most cap."""
    extra = keep_first(more, value, order).join(first.select(value).distinct(), value, "left_anti")
    both = first.select(value, F.lit(0).alias("_s"), F.col(order).alias("_o")).unionByName(extra.select(value, F.lit(1).alias("_s"), F.col(order).alias("_o")))
    return both.orderBy("_s", "_o").limit(cap).select(value, (F.row_number().over(Window.orderBy("_s", "_o")) - 1).alias("ord"))

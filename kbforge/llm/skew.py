"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in SHARE, and more than LEAST rows, is dealt over several tasks.
SHARE, LEAST = 4096, 500


def _heavy(keys: DataFrame, rows: int) -> DataFrame:
    """Heavy keys and the number of parts of each, `_parts`: at most SHARE rows for each row that a key may stand in, so it may be broadcast."""
    limit = max(LEAST, rows // SHARE)
    found = keys.groupBy(*keys.columns).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    return F.broadcast(found.select(*keys.columns, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))


def _salt(by: list[str]) -> Column:
    return F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("_parts"))).cast("int")


def _repeated(one: DataFrame, heavy: DataFrame, on: list[str]) -> DataFrame:
    """A row of `one` for every part of its key."""
    return one.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """many.join(one, on, how) for an inner or left join, `many` being cheap to read twice (written before). Rows of `many` with a
    heavy key are dealt by a hash of the columns `by`, and the rows of `one` with such a key are repeated."""
    heavy = _heavy(many.select(*on), many.count())
    left = many.join(heavy, on, "left").withColumn("_salt", _salt(by)).drop("_parts")
    return left.join(_repeated(one, heavy, on), [*on, "_salt"], how).drop("_salt")


def with_both_ends(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b), written before, with the columns of rows(key, ...) for both ends, named with _a and _b; ends in very many pairs are dealt over tasks."""
    ends = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key)))
    heavy = _heavy(ends, pairs.count())
    out = pairs
    for end, other in (("a", "b"), ("b", "a")):
        out = out.join(heavy.withColumnRenamed(key, end), end, "left").withColumn(f"_salt_{end}", _salt([other])).drop("_parts")
    side = _repeated(rows, heavy, [key])
    for end in ("a", "b"):
        own = side.select(F.col(key).alias(end), F.col("_salt").alias(f"_salt_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != key])
        out = out.join(own, [end, f"_salt_{end}"]).drop(f"_salt_{end}")
    return out

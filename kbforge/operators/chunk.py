"""Overlapping character windows over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.functions.text import strip


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of stripped windows; the first one that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.length(text) - size) / F.lit(float(step))).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: strip(F.substring(text, (i * step + 1).cast("int"), F.lit(size))))


def chunks(docs: DataFrame, key: str, text: str, size: int = 2200, overlap: int = 300, least: int = 250) -> DataFrame:
    """Rows (key, chunk_id, chunk): kept windows numbered from 1. Base variant: 2500, 300, 300. No shuffle: a row yields its windows."""
    kept = F.filter(windows(F.col("_t"), size, overlap), lambda c: F.length(c) >= least)
    rows = docs.select(key, strip(F.coalesce(F.col(text), F.lit(""))).alias("_t")).select(key, F.posexplode(kept).alias("_i", "chunk"))
    return rows.select(key, (F.col("_i") + 1).alias("chunk_id"), "chunk")

"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), each step a shuffle over edges.

Up to FEW edges, counted first, one task joins them with a union-find, which takes a few MB; more edges take the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.scratch import written

FEW = 100_000


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from larger to smaller; each node and its smaller neighbours go to the smallest of these."""
    least = _min_neighbour(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    names, flat = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in flat.reshape(2, -1).T.tolist():
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[[top(x) for x in range(len(names))]])], ["node", "component"])


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Edges (a, b) of longs to rows (node, component): the smallest node that each reaches. Nodes without an edge have no row; loops and repeats don't matter."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_union_find, "node bigint, component bigint")
    now = written(edges.distinct(), label)
    before = _state(now)
    while True:
        now = written(_small_star(_large_star(now)), label)
        after = _state(now)
        if after == before:
            break
        before = after
    # At the fixed point every edge runs from a node to its component's smallest one.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

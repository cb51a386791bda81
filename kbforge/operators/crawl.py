"""Breadth-first crawl, one DataFrame round a level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbforge.scratch import written


def bfs_crawl(seeds: DataFrame, fetch_links: Callable[[DataFrame], DataFrame], max_depth: int = 2, max_pages: int = 300, history: DataFrame | None = None) -> DataFrame:
    """seeds(url, ord) to rows (url, depth, position, ok) in fetch order.

    fetch_links takes rows (url, ...) and returns (url, ok, links array<string>), links empty where the fetch failed. A URL is
    queued once; one that history holds is passed over and not expanded; successes up to max_pages count, failures don't. A level is fetched
    in slices of the successes still wanted, so nothing beyond the cap is fetched but for what fails. The pages of a crawl are at most max_pages and its failures, so each level is small and its order is taken in one window.
    """
    queue = seeds.groupBy("url").agg(F.min("ord").alias("ord")).withColumn("depth", F.lit(0))
    queued = queue.select("url")
    done, taken, offset = None, 0, 0
    for depth in range(max_depth + 1):
        level = queue if history is None else queue.join(history.select("url").distinct(), "url", "left_anti")
        level = written(level.withColumn("ord", F.row_number().over(Window.orderBy("ord"))), "bfs-level")
        size, at, n, parts = level.count(), 0, 0, []
        while at < size and taken < max_pages:
            part = level.where((F.col("ord") > at) & (F.col("ord") <= at + max_pages - taken))
            part = written(part.join(fetch_links(part), "url").withColumn("position", F.row_number().over(Window.orderBy("ord"))), "bfs-slice")
            at += max_pages - taken
            m, ok = part.agg(F.count("*"), F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0))).first()
            parts.append(part.withColumn("position", F.col("position") + offset))
            n, taken, offset = n + m, taken + ok, offset + m
        if not parts:
            break
        got = parts[0]
        for part in parts[1:]:
            got = got.unionByName(part)
        rows = got.select("url", "depth", "position", "ok")
        done = rows if done is None else done.unionByName(rows)
        if depth == max_depth or taken >= max_pages or not n:
            break
        links = got.where("ok").select("position", F.posexplode("links").alias("i", "child"))
        fresh = links.groupBy(F.col("child").alias("url")).agg(F.min(F.struct("position", "i")).alias("at")).join(queued, "url", "left_anti")
        queue = fresh.select("url", F.row_number().over(Window.orderBy("at")).alias("ord"), F.lit(depth + 1).alias("depth"))
        queue = written(queue, "bfs-queue")
        queued = queued.unionByName(queue.select("url"))
    return done if done is not None else queue.select("url", "depth", F.lit(0).alias("position"), F.lit(True).alias("ok")).where("false")

"""Settings with their defaults, overridden by environment variables or spark.conf entries of the same name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    top_k: int = 30
    rerank_top_n: int = 5
    use_reranker: bool = True
    embed_batch: int = 8
    rerank_batch: int = 8
    max_tokens: int = 8192
    max_pages: int = 300
    max_depth: int = 2
    chunk_size: int = 2200
    chunk_overlap: int = 300
    min_chunk: int = 250
    min_content: int = 120
    query_task: str = "Given a question, retrieve the passages that answer it"

    @staticmethod
    def load(spark: SparkSession | None = None) -> "Config":
        found = {}
        for f in fields(Config):
            value = os.environ.get(f.name.upper())
            if spark is not None:
                value = spark.conf.get(f"kbforge.{f.name}", value)
            if value is not None:
                found[f.name] = value == "1" if isinstance(f.default, bool) else type(f.default)(value)
        return Config(**found)

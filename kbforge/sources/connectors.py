"""Outside services behind small protocols, each with a deterministic stand-in for tests and offline runs."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.config import Config
from kbforge.functions.text import json_clean
from kbforge.functions.urls import domain_allowed
from kbforge.scratch import written


class Fetcher(Protocol):
    """url to (final url, content type, body); None when it fails."""

    def __call__(self, url: str) -> tuple[str, str, bytes] | None: ...


class Completer(Protocol):
    """A prompt to a model's reply; may raise."""

    def __call__(self, prompt: str) -> str: ...


class ChatCompleter(Protocol):
    """Messages (role, content) and settings to a model's reply; may raise."""

    def __call__(self, messages: list[dict[str, str]], **options) -> str: ...


def fetch(urls: DataFrame, fetcher: Fetcher, url: str = "url") -> DataFrame:
    """Rows (url, final_url, content_type, body), nulls where the fetch failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(u, *(fetcher(u) or (None, None, None))) for u in batch[url]]
            yield pd.DataFrame(got, columns=["url", "final_url", "content_type", "body"])

    return urls.select(url).mapInPandas(run, "url string, final_url string, content_type string, body binary")


def ask_json(prompts: DataFrame, complete: Completer, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts(id, prompt) to rows (id, reply): the cleaned reply of the first try that is a JSON object, else '{}'."""

    def one(prompt: str) -> str:
        for i in range(retries + 1):
            try:
                text = complete(prompt).strip()
                text = text.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
                start, end = text.find("{"), text.rfind("}")
                return json.dumps(dict(json.loads(text if text.startswith("{") else text[start : end + 1])), ensure_ascii=False)
            except Exception:  # services fail in many ways; each counts as a try
                if i < retries:
                    wait(1 + i)
        return "{}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "reply": [one(p) for p in batch["prompt"]]})

    return prompts.select(F.col("id").cast("string"), "prompt").mapInPandas(run, "id string, reply string")


#: Prompts of one wave: what a run that breaks off asks again at most.
WAVE = 10_000


def ask_once(prompts: DataFrame, complete: Completer, store: str, retries: int = 2, wait: Callable[[float], None] = time.sleep, wave: int = WAVE) -> DataFrame:
    """ask_json with a store of replies by the prompt's hash. Equal prompts are asked once, and none that the store has. Replies are written wave by
    wave, so what an earlier run has paid for stays when it broke off; failures ('{}') aren't stored, the next run asks them again."""
    spark = prompts.sparkSession
    rows = prompts.select(F.col("id").cast("string").alias("id"), "prompt", F.sha2("prompt", 256).alias("key"))
    schema = "key string, reply string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    known = lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store)
    missing = written(rows.groupBy("key").agg(F.first("prompt").alias("prompt")).join(known().select("key"), "key", "left_anti"), "prompts")
    waves = -(-missing.count() // wave)
    for k in range(waves):
        part = missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == k).select(F.col("key").alias("id"), "prompt")
        replies = ask_json(part, complete, retries, wait).select(F.col("id").alias("key"), "reply").where("reply <> '{}'")
        replies.write.mode("append").parquet(f"{store}/{uuid.uuid4().hex}")
    return rows.join(known().dropDuplicates(["key"]), "key", "left").select("id", F.coalesce("reply", F.lit("{}")).alias("reply"))


def search_web(keywords: DataFrame, hits: DataFrame, most: int, domains: tuple[str, ...] = ()) -> DataFrame:
    """keywords(keyword) against a table hits(keyword, ord, url, title, snippet): the first `most` of each, then those with a URL in the domains. A keyword whose search failed has no hits."""
    first = hits.join(keywords.select("keyword").distinct(), "keyword", "left_semi").where(F.col("ord") < most)
    return first.where((F.coalesce("url", F.lit("")) != "") & domain_allowed(F.col("url"), domains))


def hashed_vector(text: str, dim: int = 64) -> np.ndarray:
    """A unit vector from hashed character trigrams: equal texts, equal vectors; shared trigrams bring vectors near."""
    v = np.zeros(dim, np.float64)
    padded = f"  {text} "
    for i in range(len(padded) - 2):
        d = hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "little") % dim] += 1 if d[4] & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def by_length(call: Callable[[list], list], values: list, batch: int, size: Callable = len) -> list:
    """call over values in batches of about the same size, longest first; results in the order of the values."""
    order = sorted(range(len(values)), key=lambda i: -size(values[i]))
    out: list = [None] * len(values)
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        for i, x in zip(own, call([values[i] for i in own]), strict=True):
            out[i] = x
    return out


_loaded: dict[str, Callable[[list[str]], list[np.ndarray]]] = {}


def embedder(dim: int = 64, model: Callable[[str], np.ndarray] | None = None, load: Callable[[], Callable[[list[str]], list[np.ndarray]]] | None = None, name: str = "", batch: int = 8, max_tokens: int = 8192):
    """Pandas UDF text to vector, `batch` texts of about the same length a call, each cut to its first max_tokens words (a service counts its own tokens).

    load gives the model (texts to vectors); it runs once per worker process and `name`, at its first batch, and is what is shipped
    instead of the model. Without one, model maps a text at a time; without either, vectors are hashed from trigrams."""

    def ready() -> Callable[[list[str]], list[np.ndarray]]:
        if load is None:
            one = model or (lambda x: hashed_vector(x, dim))
            return lambda texts: [one(t) for t in texts]
        if name not in _loaded:
            _loaded[name] = load()
        return _loaded[name]

    def cut(text: str | None) -> str:
        words = (text or "").split(None, max_tokens)
        return text or "" if len(words) <= max_tokens else " ".join(words[:max_tokens])

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = ready()
        for part in texts:
            yield pd.Series(by_length(encode, [cut(t) for t in part], batch), index=part.index, dtype=object)

    return run


def overlap_score(query: str, text: str) -> float:
    """Share of the query's distinct words that the text holds."""
    q = set((query or "").lower().split())
    return len(q & set((text or "").lower().split())) / len(q) if q else 0.0


def cross_scorer(model: Callable[[str, str], float] = overlap_score, many: Callable[[list[tuple[str, str]]], list[float]] | None = None, batch: int = 8):
    """Pandas UDF (query, text) to score. many scores a list of pairs at once: it gets `batch` of about the same length a call."""
    score = many or (lambda pairs: [model(q, t) for q, t in pairs])

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        pairs = [(q or "", t or "") for q, t in zip(query, text)]
        return pd.Series([float(x) for x in by_length(score, pairs, batch, lambda p: len(p[0]) + len(p[1]))], index=query.index, dtype="float64")

    return run


def services(config: Config, load: Callable | None = None, name: str = "", many: Callable[[list[tuple[str, str]]], list[float]] | None = None):
    """(embed, score) UDFs with the batch sizes and the token limit of the settings."""
    return embedder(load=load, name=name, batch=config.embed_batch, max_tokens=config.max_tokens), cross_scorer(many=many, batch=config.rerank_batch)


#: Settings of a chat request, and the one that a service may not know (fixed values).
CHAT_OPTIONS = {"temperature": 0.2, "top_p": 0.8, "max_tokens": 512, "chat_template_kwargs": {"enable_thinking": False}}
OPTIONAL = "chat_template_kwargs"


def generate(requests: DataFrame, complete: ChatCompleter, options: dict = CHAT_OPTIONS) -> DataFrame:
    """requests(id, messages array<struct<role,content>>) to rows (id, answer). A failure that names the optional setting is tried once
    more without it; any other one becomes the answer's text."""

    def one(messages: list[dict[str, str]]) -> str:
        try:
            try:
                return complete(messages, **options)
            except Exception as e:
                if OPTIONAL not in options or OPTIONAL not in str(e):
                    raise
                return complete(messages, **{k: v for k, v in options.items() if k != OPTIONAL})
        except Exception as e:
            return f"运行出错：{e!r}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chats = [[{"role": m["role"], "content": m["content"]} for m in ms] for ms in batch["messages"]]
            yield pd.DataFrame({"id": batch["id"], "answer": [one(c) for c in chats]})

    return requests.select(F.col("id").cast("string"), "messages").mapInPandas(run, "id string, answer string")


__all__ = ["Fetcher", "Completer", "ChatCompleter", "CHAT_OPTIONS", "fetch", "ask_json", "ask_once", "search_web", "hashed_vector", "embedder", "overlap_score", "cross_scorer", "services", "generate", "json_clean"]

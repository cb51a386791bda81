"""Operator 10, quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-proximal).

Features are hashes of lower-cased words and of word pairs, and of each word's shape (first and last characters' classes and length:
a word's n-gram stripped of its letters, which tells junk of any vocabulary), folded into 2**BITS buckets; a document's value of
a bucket is log(1 + its count there) over the Euclidean norm of these. Scoring is a sparse dot product, a vector operation per slice
of bytes. Training takes labelled rows only; where there are more than MAX_LABELLED of them, those with the lowest hash of doc_id (a
bounded sample, the same at every size). Their features are written and read in order, a partition at a time, once an epoch, so the
driver holds the weights and one partition's features.

Null or empty text: no features, the score is the bias alone. No labelled rows, or of one class only: the weights stay
at what the updates give, scores stay in 0..1. Ties and repeated rows are scored alike; repeated labels of one doc_id
each count. A null doc_id is scored, and not held out. An empty table gives an empty table; other columns, doc_id included, never enter a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import kernel
from kbforge.llm.scratch import written

BITS = 18
#: Bound on the labelled rows that training reads.
MAX_LABELLED = 20_000
#: FTRL-proximal: step, its smoothing, and the two penalties; passes over the training rows.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1e-4, 1e-5, 3
THRESHOLD = 0.3

_LETTER_CLASS = np.full(256, 3, np.uint8)
_LETTER_CLASS[65:91] = 0
_LETTER_CLASS[97:123] = 1
_LETTER_CLASS[48:58] = 2
_LETTER_CLASS[128:] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of a slice, sorted by document and bucket."""
    w = kernel.Words(data, offsets)
    doc = w.doc_of_word()
    h = w.hashes(fold=True)
    first, last = _LETTER_CLASS[data[w.starts]], _LETTER_CLASS[data[w.ends - 1]]
    second_last = _LETTER_CLASS[data[np.maximum(w.ends - 2, w.starts)]]
    shape = kernel.mix((first.astype(np.uint64) * 25 + second_last * 5 + last) * np.uint64(32) + np.minimum(w.ends - w.starts, 31).astype(np.uint64), 77)
    pair = kernel.windows(h, 2)
    inner = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    key = np.concatenate([h, shape, pair[inner]]) >> np.uint64(64 - BITS)
    of = np.concatenate([doc, doc, doc[:-1][inner]])
    both = np.sort((of.astype(np.uint64) << np.uint64(BITS)) | key)
    if not len(both):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.append(at, len(both))).astype(np.float64)
    of, key = (both[at] >> np.uint64(BITS)).astype(np.int64), (both[at] & np.uint64((1 << BITS) - 1)).astype(np.int64)
    count = np.log1p(count)
    norm = np.sqrt(np.bincount(of, count * count, len(offsets) - 1))
    return of, key, (count / norm[of]).astype(np.float32)


def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, y, text) to (y, keys, values)."""
    for batch in batches:
        for a, b, data, offsets in kernel.slices(batch.column("text")):
            of, key, value = features(data, offsets)
            cut = np.searchsorted(of, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    batch.column("y").slice(a, b - a),
                    pa.array([key[i:j].astype(np.uint32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                    pa.array([value[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                ],
                ["doc_id", "y", "keys", "vals"],
            )


def train(epoch: Callable[[], Iterable[tuple[float, bytes, bytes]]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, keys, values), gone through EPOCHS times; returns weights and bias. The last coordinate is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for y, keys, values in epoch():
            k = np.append(np.frombuffer(keys, np.uint32).astype(np.int64), size - 1)
            x = np.append(np.frombuffer(values, np.float32), 1.0)
            zk, nk = z[k], n[k]
            p = 1.0 / (1.0 + np.exp(-np.clip(_weights(zk, nk) @ x, -30, 30)))
            g = (p - y) * x
            g2 = g * g
            z[k] = zk + g - (np.sqrt(nk + g2) - np.sqrt(nk)) / ALPHA * _weights(zk, nk)
            n[k] = nk + g2
    w = _weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Trains on the labelled rows of docs(doc_id, text), at most max_labelled of them."""
    chosen = (
        labels.select("doc_id", F.col(label).cast("double").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    found = written(rows.mapInArrow(featurize, "doc_id bigint, y double, keys binary, vals binary"), "qc-features")
    order = [F.xxhash64("doc_id"), "doc_id", "y", "keys"]
    if found.count() > max_labelled:  # labelled documents that stand there more than once
        found = written(found.orderBy(*order).limit(max_labelled), "qc-features")
    ordered = found.orderBy(*order).select("y", "keys", "vals")
    return train(ordered.toLocalIterator)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """Rows (doc_id, score)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for a, b, data, offsets in kernel.slices(batch.column(1)):
                of, key, value = features(data, offsets)
                dot = np.bincount(of, weights[key].astype(np.float64) * value, b - a) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1.0 / (1.0 + np.exp(-np.clip(dot, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, score double")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs, labels.where(~held), "quality")
    return score(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted")
    )

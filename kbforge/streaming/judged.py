"""First-accepted-wins over a stream of pages: whole rows come out, batch by batch, each exactly once.

A batch is judged against the keys that earlier batches accepted (a KeyStore: only the batch is moved), its rows replace the batch's
partition of the output, and its accepted keys replace the batch's partition of the store. A batch that breaks off and is run again therefore leaves
what it would have left at once. Within a batch the first accepted row of a key is found by a partial aggregation, so a key with very
many rows gathers in no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.operators import dedup
from kbforge.sources.keystore import KeyStore


def run_name(batch: int) -> str:
    return f"batch-{batch:012d}"


def judge_batch(rows: DataFrame, batch: int, store: KeyStore, out: str, order: str = "ord", accepted: str = "useful") -> None:
    """rows with `status` to out/batch=<batch>; the accepted keys to the store. Rows with a null key are judged by themselves."""
    run = run_name(batch)
    known = store.keys(run).distinct()
    status = dedup.accepted_first(rows, store.key, order, F.col(accepted), known)
    status.withColumn("batch", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
    judged = rows.sparkSession.read.schema(status.schema).parquet(f"{out}/batch={run}")
    store.add(judged.where("status = 'kept'").select(store.key), run)


def run_available(pages: DataFrame, store: KeyStore, out: str, checkpoint: str, order: str = "ord", accepted: str = "useful") -> None:
    """Judges what the stream `pages` has beyond the checkpoint, then stops."""
    query = pages.writeStream.foreachBatch(lambda rows, batch: judge_batch(rows, batch, store, out, order, accepted)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append(rows: DataFrame, batch: int, path: str) -> None:
    """JSON lines of a batch, in place of what a broken-off try of the same batch left: path/batch=<batch>."""
    rows.withColumn("batch", F.lit(run_name(batch))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)

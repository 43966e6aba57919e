"""Incremental ingestion and job progress (STM1-5, STM8, STM10-11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, files: int = 100, kind: str = "parquet") -> StreamingQuery:
    """New files of a folder in batches; ``work`` must be idempotent by batch id (STM1).

    Takes what is there and stops; the next call goes on from the checkpoint.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(events: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """The last values of each key (STM2, STM8); the same for a table and for a stream."""
    out = events.groupBy(key).agg(F.max_by(F.struct(*values), at).alias("v"), F.max(at).alias(at))
    return out.select(key, at, "v.*")


def status(step: Column, total: int = 7) -> Column:
    """A job's state by its last step (STM3)."""
    return F.when(step.isNull(), "not_found").when(step < 0, "failed").when(step == 0, "pending").when(step < total, "started").otherwise("finished")


def graph_jobs(documents: DataFrame, enabled: bool = True) -> DataFrame:
    """Documents whose graph is to be built next: policies with a forest (STM5)."""
    return documents.where(F.lit(enabled) & (F.col("doc_type") == "policy") & (F.col("clause_count") > 0))


def answers(parts: DataFrame, key: str) -> DataFrame:
    """Streamed parts (key, seq, kind, text) as whole texts by kind (STM10)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return parts.groupBy(key, "kind").agg(text.alias("text"))


def token_speed(parts: DataFrame, key: str) -> DataFrame:
    """(key, ttft, tps) of token events (key, ts, start) in seconds (STM11)."""
    seconds = F.col("ts").cast("double")
    out = parts.groupBy(key).agg(F.min(seconds).alias("first"), F.max(seconds).alias("last"), F.min(F.col("start").cast("double")).alias("start"), F.count(F.lit(1)).alias("n"))
    return out.select(key, (F.col("first") - F.col("start")).alias("ttft"), F.try_divide(F.col("n") - 1, F.col("last") - F.col("first")).alias("tps"))


def windowed(events: DataFrame, at: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window with a watermark (an extension beyond the surveyed operators)."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count(F.lit(1)).alias("n"))

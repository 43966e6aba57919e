"""Event-sourced state with branches (STM6-7, STM13-14).

Events: thread, branch, seq, key, value. The state at a point is the fold of the events up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_at(events: DataFrame, seq: int | Column | None = None) -> DataFrame:
    """(thread, branch, state): the last non-empty value of each key up to a point."""
    rows = events.where(F.col("seq") <= seq) if seq is not None else events
    last = rows.where(F.coalesce("value", F.lit("")) != "").groupBy("thread", "branch", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("thread", "branch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("state"))


def fork(events: DataFrame, branch: str, seq: int, new: str) -> DataFrame:
    """The events of a branch up to a point, copied as a new branch."""
    return events.where((F.col("branch") == branch) & (F.col("seq") <= seq)).withColumn("branch", F.lit(new))


def checkpoints(events: DataFrame, thread: str, limit: int = 20) -> DataFrame:
    """The latest checkpoints of a thread, newest first; 1 to 100 (TOP4)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1 and 100")
    return events.where(F.col("thread") == thread).orderBy(F.desc("seq"), "key").limit(limit)


def log(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Messages (keys, seq, payload) as ordered lists (STM14)."""
    return messages.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]).alias("log"))


def route(tool_calls: Column, valid_output: Column, approved: Column) -> Column:
    """Where a step goes next (STM13)."""
    return F.when(tool_calls > 0, "tools").when(~valid_output, "tools").when(~approved, "approval").otherwise("end")

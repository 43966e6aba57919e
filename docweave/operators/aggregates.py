"""Aggregations (AGG1-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen (AGG1)."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def joined(column: str | Column, sep: str = "<SEP>") -> Column:
    """Sorted distinct values joined by a mark (AGG2)."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def merged_ids(column: str) -> Column:
    """Sorted distinct union of lists (AGG4)."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def shortened(column: Column, sep: str = "<SEP>", length: int = 512, parts: int = 5, summarise=None) -> Column:
    """The first characters; beyond so many parts a summariser, if given, has its say (AGG3)."""
    cut = F.substring(column, 1, length)
    return cut if summarise is None else F.when(F.size(F.split(cut, sep)) > parts, summarise(cut)).otherwise(cut)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out of each node (AGG6)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def percentile(rows: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """p<percent> of each group: the sorted value at min(floor(n p / 100), n - 1), from 0 (AGG8).

    Positions come from a count per distinct value, so no group is gathered in one place.
    """
    rows = rows.where(F.col(value).isNotNull())
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(value) if keys else Window.orderBy(value)
    upto = counted.withColumn("upto", F.sum("c").over(w))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    met = upto.join(F.broadcast(total)) if not keys else upto.join(total, keys)
    index = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return met.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > index(p), F.col(value))).alias(f"p{p}") for p in percents])


def parse_quality(pages: DataFrame, few: int = 10) -> DataFrame:
    """(doc_id, pages, empty_pages, empty_ratio, avg_length, verdict) of parsed pages (doc_id, text) (AGG11)."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    out = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum((size < few).cast("int")).alias("empty_pages"), F.avg(size).alias("avg_length"))
    out = out.withColumn("empty_ratio", F.col("empty_pages") / F.col("pages"))
    verdict = F.when(F.col("empty_ratio") > 0.8, "fail").when(F.col("empty_ratio") > 0.3, "warn").when(F.col("avg_length") < 100, "warn").otherwise("ok")
    return out.withColumn("verdict", verdict)


def latency_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, success rate and percentiles over successes of (keys, ok, latency) (AGG9)."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("int")).alias("success_rate"), F.max(F.when(F.col("ok"), F.col("latency"))).alias("slowest"))
    return counts.join(percentile(rows.where("ok"), keys, "latency", [50, 95]), keys, "left")


def qps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Successes over the longest latency in seconds, and mean chunks (AGG10); rows have ok, latency, chunks."""
    ok = F.when(F.col("ok"), 1)
    return rows.groupBy(*keys).agg(F.try_divide(F.count(ok), F.max(F.when(F.col("ok"), F.col("latency")))).alias("qps"), F.avg(F.when(F.col("ok"), F.col("chunks"))).alias("mean_chunks"))


def accuracy(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Share of equal labels among rows that have both, to 4 decimals (AGG12)."""
    both = rows.where(F.col(expected).isNotNull() & F.col(predicted).isNotNull())
    return both.agg(F.round(F.avg((F.col(expected) == F.col(predicted)).cast("int")), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def outcomes(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """total, success, failed, timeout (AGG13, STM4)."""
    of = lambda s: F.count(F.when(F.col(status) == s, 1))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), of("success").alias("success"), of("failed").alias("failed"), of("timeout").alias("timeout"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where the keys are unique (AGG16, AGG17)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cache_gain(runs: DataFrame, run: str = "run", value: str = "ttft") -> DataFrame:
    """How much lower the mean of later runs is than the first: 1 - avg(run 2..) / run 1 (AGG20)."""
    first, rest = F.max(F.when(F.col(run) == 1, F.col(value))), F.avg(F.when(F.col(run) > 1, F.col(value)))
    return runs.agg((1 - F.try_divide(rest, first)).alias("drop"))

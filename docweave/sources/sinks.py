"""Sinks (SNK1-11). Tables are Parquet folders; a replaced one is written beside the old and swapped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.shared import shared_path
from docweave.operators.predicates import matching


def insert(rows: DataFrame, path: str, declared: list[str]) -> None:
    """Append the declared fields; others are dropped (SNK1)."""
    rows.select([c for c in declared if c in rows.columns]).write.mode("append").parquet(path)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"cannot move {old} to {new}")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def rewrite(rows: DataFrame, path: str) -> None:
    """Replace a table by rows that may come from it."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    _rename(rows.sparkSession, beside, path)


def delete(spark: SparkSession, path: str, conditions: dict) -> int:
    """Delete matching rows; returns how many (SNK2)."""
    rows = spark.read.parquet(path)
    gone = F.coalesce(matching(conditions), F.lit(False))
    n = rows.where(gone).count()
    rewrite(rows.where(~gone), path)
    return n


def update(spark: SparkSession, path: str, conditions: dict, values: dict) -> None:
    """Set values in matching rows (SNK7)."""
    rows = spark.read.parquet(path)
    hit = F.coalesce(matching(conditions), F.lit(False))
    rewrite(rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in values.items()}), path)


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Insert rows, replacing those of equal keys (SNK3-4)."""
    old = rows.sparkSession.read.parquet(path)
    rewrite(old.join(rows.select(keys), keys, "left_anti").select(old.columns).unionByName(rows, allowMissingColumns=True), path)


def stored_edges(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Edges as they are stored (SNK5): ends must exist, other types become RELATED_TO with rel_type."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    known = F.col("type").isin(types)
    return out.select("src", "dst", F.when(known, F.col("type")).otherwise("RELATED_TO").alias("type"), F.when(~known, F.col("type")).alias("rel_type"))


def without_document(nodes: DataFrame, edges: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without a document's, and one row of what goes: (nodes, edges) (SNK6)."""
    gone = nodes.where(F.col("doc_id") == doc_id).select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    counts = gone.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("all")), how="cross").join(left.agg(F.count(F.lit(1)).alias("kept")), how="cross")
    return nodes.where(F.col("doc_id") != doc_id), left.select(edges.columns), counts.select("nodes", (F.col("all") - F.col("kept")).alias("edges"))


def as_json(rows: DataFrame, path: str) -> None:
    """JSON lines (SNK8); null fields are left out (JSN1)."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def as_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV export of fixed columns (SNK9)."""
    rows.select(columns).write.mode("overwrite").csv(path, header=True)


def import_rows(rows: DataFrame, order: str, reason, good: str, bad: str, batch: int = 100, start: int = 0) -> DataFrame:
    """Import in numbered batches from ``start`` on; rows with a reason go to a dead-letter CSV (SNK10-11).

    Returns (batch, ok, failed). ``reason`` is a Column, null for good rows. Batches are numbered
    by counting rows per range of the order first, nulls last, so no task holds all rows. Ranges and
    numbers are written once: bounds are sampled and ranges merged anew each time a plan runs.
    """
    spark, first = rows.sparkSession, F.asc_nulls_last(order)
    ranges, numbered = shared_path(spark, "ranges"), shared_path(spark, "numbered")
    rows.repartitionByRange(first).withColumns({"_p": F.spark_partition_id(), "reason": reason.cast("string")}).write.parquet(ranges)
    parts = spark.read.parquet(ranges)
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offset = sizes.withColumn("_o", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c")
    n = F.row_number().over(Window.partitionBy("_p").orderBy(first)) + F.col("_o") - 1
    marked = parts.join(F.broadcast(offset), "_p").withColumn("batch", F.floor(n / batch)).drop("_p", "_o")
    marked.where(F.col("batch") >= start).write.parquet(numbered)
    _delete(spark, ranges)
    marked = spark.read.parquet(numbered)
    marked.where("reason is null").drop("batch", "reason").write.mode("append").parquet(good)
    marked.where("reason is not null").drop("batch").write.mode("append").csv(bad, header=True)
    return marked.groupBy("batch").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("ok"), F.count("reason").alias("failed"))

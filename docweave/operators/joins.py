"""Join shapes (JN1-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ends(edges: DataFrame, nodes: DataFrame, id_: str = "id") -> DataFrame:
    """Edges (src, dst, ...) whose two ends exist (JN2)."""
    ids = nodes.select(F.col(id_)).distinct()
    out = edges.join(ids.withColumnRenamed(id_, "src"), "src", "left_semi").join(ids.withColumnRenamed(id_, "dst"), "dst", "left_semi")
    return out.select(edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame, id_: str = "id") -> DataFrame:
    """Edges of which an end is missing."""
    ids = nodes.select(F.col(id_).alias("_id")).distinct()
    lost_src = edges.join(ids, edges.src == F.col("_id"), "left_anti")
    return lost_src.unionByName(edges.join(ids, edges.src == F.col("_id"), "left_semi").join(ids, edges.dst == F.col("_id"), "left_anti"))


def in_range_first(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str, end: str, order: str) -> DataFrame:
    """Each point with the first range of its key that holds it (JN7); the key makes it a hash join."""
    met = points.join(ranges, key, "inner").where(F.col(point).between(F.col(start), F.col(end)))
    w = Window.partitionBy(*points.columns).orderBy(start, order)
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def zipped(left: Column, right: Column) -> Column:
    """Two arrays element by element; unequal lengths are an error (JN11)."""
    same = F.assert_true(F.size(left) == F.size(right), F.lit("lists differ in length"))
    return F.when(same.isNull(), F.arrays_zip(left.alias("left"), right.alias("right")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both by key; a new row's non-null values win (JN14, SNK3, SNK4)."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    return old.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])

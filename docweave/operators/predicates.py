"""Filters and projections (FLT1-17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.sized import small_side

#: Types that a typed projection keeps; all others become text.
KEPT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def matching(conditions: dict | str | Column | None) -> Column:
    """A conjunctive filter: lists test membership, other values equality; None and {} are true (FLT1-3)."""
    if conditions is None or (isinstance(conditions, dict) and not conditions):
        return F.lit(True)
    if isinstance(conditions, Column):
        return conditions
    if isinstance(conditions, str):
        return F.expr(conditions)
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in conditions.items()]
    return reduce(lambda a, b: a & b, parts)


def select_all(df: DataFrame, **values) -> DataFrame:
    """Rows equal to every keyword; at least one is needed (FLT4)."""
    if not values:
        raise ValueError("give at least one column to compare")
    return df.where(matching(values))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a primary key (FLT5)."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def bulk(df: DataFrame, ids: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """Rows whose key is listed (FLT6)."""
    out = df.join(small_side(ids.select(key).distinct()), key, "left_semi")
    return out.select(fields) if fields else out


def typed(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields as they are read back: numbers stay, others become text, null text is "" (FLT8).

    Fields that the table does not have are left out.
    """
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.col(c) if isinstance(types[c], KEPT_TYPES) else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields if c in types])


def missing_fields(columns: list[str]) -> Column:
    """Names of those columns that are null or empty (FLT13)."""
    named = [F.struct(F.lit(c).alias("n"), F.col(c).cast("string").alias("v")) for c in columns]
    return F.transform(F.filter(F.array(*named), lambda x: F.coalesce(x["v"], F.lit("")) == ""), lambda x: x["n"])


def without_nulls(array: Column) -> Column:
    """An array without its nulls (FLT16)."""
    return F.filter(array, lambda x: x.isNotNull())


def tidy(nodes: DataFrame, edges: DataFrame, attribute: str = "description") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that have the attribute; edges only between nodes that stay (FLT17)."""
    nodes = nodes.where(F.col(attribute).isNotNull())
    ids = nodes.select("id")
    edges = edges.where(F.col(attribute).isNotNull())
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])

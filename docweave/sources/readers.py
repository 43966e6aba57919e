"""Sources (SRC1-12, UDF2): every reader names its schema, so nothing is inferred from data."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which parser reads a file, by extension and by content type.
BY_EXTENSION = {".pdf": "pdf", ".txt": "text", ".md": "text", ".markdown": "text"}
BY_TYPE = {"application/pdf": "pdf", "text/plain": "text", "text/markdown": "text"}


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", skip_bad: bool = False) -> DataFrame:
    """A delimited file with a header (SRC1-3); malformed rows are dropped if asked, else read with nulls."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True, mode="DROPMALFORMED" if skip_bad else "PERMISSIVE")


def json_lines(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON, one value a line or one a file (SRC4)."""
    return spark.read.schema(schema).json(path, multiLine=whole)


def binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of files (SRC5)."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files (SRC6)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parser_of(filename: Column, content_type: Column) -> Column:
    """Which parser reads a file (SRC8): by extension, else by content type without parameters, else null."""
    ext = F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1))
    kind = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.coalesce(F.try_element_at(table(BY_EXTENSION), ext), F.try_element_at(table(BY_TYPE), kind))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of their key (SRC11)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def subgraph_of(nodes: DataFrame, edges: DataFrame, doc_id: str, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """A document's nodes, and the edges between them of the given types (SRC10).

    An edge stored as RELATED_TO has its type in rel_type.
    """
    mine = nodes.where(F.col("doc_id") == doc_id)
    kind = F.when(F.col("type") == "RELATED_TO", F.coalesce("rel_type", "type")).otherwise(F.col("type"))
    ids = mine.select("id")
    out = edges.withColumn("type", kind).where(F.col("type").isin(types))
    return mine, out.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def settings(text: str, environment: dict | None = None) -> str:
    """A configuration text with ${NAME:-default} places filled (SRC12)."""
    env = os.environ if environment is None else environment
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] or ""), text)

"""A corpus from documents: quality rules, near duplicates, benchmark passages, personal data, token ids.

Each stage works on all that the one before it kept and returns the columns of documents; the
last one returns token ids in place of the text. Extra columns pass through, also those named like
an operator's results; an empty table makes empty tables; a very long text is one row like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontam, forced_bpe, near_dup, pii, quality
from docweave.llm.tables import cut, made, release, release_since, sized


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no result of an operator has, and the name of each column there."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def renamed(rows: DataFrame, docs: DataFrame, at: dict[str, str]) -> DataFrame:
    """The columns of docs from rows under plain() names; n_chars counts the new texts."""
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return rows.select(list(at.values())).toDF(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; lines that a host's documents share go from the rest.

    Null and empty texts have no words and go. Repeated rows are judged each on its own; rows without
    an id are documents like others. A null source is a host of its own.
    """
    rows, at = plain(docs)
    return renamed(quality.apply_rules(rows, text=at["text"], host=at["source"], rewrite=True).where("kept"), docs, at)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of smallest id.

    Of rows that repeat an id, the one of least text stays. Null and empty texts and rows without an
    id are nobody's duplicates and stay.
    """
    before = made()
    found = cut(near_dup.near_duplicates(docs).where("kept").select(F.col("id").alias("_id")), "kept")
    release_since(before, found)
    out = docs.join(sized(found.distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    with_id = found.where("_id is not null")
    if with_id.count() > with_id.distinct().count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        least = F.min_by(F.struct(*columns), F.struct("text", F.xxhash64(*columns))).alias("_row")
        out = out.where("doc_id is not null").groupBy("doc_id").agg(least).select("_row.*").unionByName(out.where("doc_id is null"))
    return out


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contract's rule go.

    Null and empty texts hold none and stay, as does everything if the benchmark is empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, at = plain(docs)
    found = decontam.decontaminate(rows, benchmark, text=at["text"], keep=rows.columns).where("not contaminated")
    return found.select(rows.columns).toDF(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced. All rows stay; null texts stay null."""
    rows, at = plain(docs)
    return renamed(pii.find_private(rows, text=at["text"], keep=rows.columns, rewrite=True), docs, at)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of each text. All rows stay; null and empty texts have no ids."""
    return forced_bpe.encode(docs)


STAGES = [
    ("quality", rules),
    ("near_duplicates", unique),
    ("decontamination", uncontaminated),
    ("private", private),
    ("encode", encode),
]
#: SQL expresses neither the tokenizer nor disclosure; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next, which deletes what it has read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = made()
        last, docs = docs, cut(stage(spark, docs, sf_dir), name)
        release(last)
        release_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Search, ingestion and claim matching composed of the operators (the surveyed entry points)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import extraction, fusion, tree, vector, windows
from docweave.operators.aggregates import parse_quality
from docweave.operators.predicates import matching
from docweave.plans.plugins import embedded, register_pipeline


def token_weights(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, token, w): blank-separated lower-case tokens and their counts, a stand-in for a sparse model."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    return df.select(F.col(id_).alias(id_), F.explode(words).alias("token")).groupBy(id_, "token").agg(F.count(F.lit(1)).cast("double").alias("w"))


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, filters: dict | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """(qid, final, part, chunk_id, clause_id, text): hybrid search merged with the chunks of chosen clauses (FUS12).

    Queries have qid, query; chunks chunk_id (bigint), text, clause_id; chosen (qid, clause_id) adds
    the clause arm. A blank query finds nothing.
    """
    queries = queries.where(F.trim("query") != "")
    chunks = chunks.where(matching(filters))
    dq = embedded(queries, "query").select("qid", "vec")
    dv = embedded(chunks, "text").select(F.col("chunk_id").alias("id"), "vec")
    hits = vector.hybrid_topk(dq, dv, token_weights(queries, "qid", "query"), token_weights(chunks, "chunk_id", "text").withColumnRenamed("chunk_id", "id"), k)
    cols = chunks.select("chunk_id", "text", "clause_id")
    found = hits.join(cols, hits.id == cols.chunk_id).select("qid", F.col("rank").alias("pos"), "chunk_id", "clause_id")
    picked = found.limit(0) if chosen is None else chosen.join(cols, "clause_id").select("qid", F.col("chunk_id").alias("pos"), "chunk_id", "clause_id")
    return fusion.merge_chunks(picked.withColumn("pos", F.col("pos").cast("bigint")), found.withColumn("pos", F.col("pos").cast("bigint"))).join(cols.drop("clause_id"), "chunk_id")


@register_pipeline("policy")
def ingest_policy(pages: DataFrame) -> dict[str, DataFrame]:
    """Parsed pages (doc_id, page, text) as quality, nodes, and chunks with pages, neighbours and clauses."""
    quality = parse_quality(pages)
    good = pages.join(quality.where("verdict <> 'fail'").select("doc_id"), "doc_id", "left_semi")
    lines = good.select("doc_id", "page", F.posexplode(F.split("text", r"\n\s*\n|\n(?=#)")).alias("i", "text"))
    lines = lines.withColumn("pos", F.col("page") * 1_000_000 + F.col("i")).withColumn("text", F.trim("text")).where("text <> ''")
    nodes = tree.forest(tree.classified(lines))
    chunks = windows.carried_page(extraction.heading_chunks(good), ["doc_id"], "pos")
    chunks = windows.neighbours(chunks, ["doc_id"], "pos", "chunk_id")
    matched = tree.matched(chunks.select("doc_id", "chunk_id", "page", "text"), nodes)
    return {"quality": quality, "nodes": nodes, "chunks": chunks.join(matched, ["doc_id", "chunk_id"])}


def match_claim(paths: DataFrame, hits: DataFrame, chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, outline): clauses from graph paths, vector hits and chosen nodes, with ancestors (FUS7).

    ``paths`` (qid, clause_ids), ``hits`` (qid, clause_path), ``chosen`` (qid, node_id); nodes as
    in the tree module with n_chunks.
    """
    ids = paths.select("qid", F.explode("clause_ids").cast("bigint").alias("node_id")).unionByName(chosen.select("qid", "node_id"))
    ids = ids.unionByName(hits.where("clause_path <> 'N/A'").select("qid", F.explode(F.split("clause_path", r"\.")).cast("bigint").alias("node_id"))).distinct()
    return tree.outline(fusion.ancestor_closure(ids, nodes).join(nodes, "node_id"), ["qid"], content=True)

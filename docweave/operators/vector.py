"""Vector search: dense, filtered, sparse and hybrid top-k, BM25, candidate groups (VEC1-5, VEC13)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import nearest
from docweave.functions.sized import small_side

#: Decimals to which scores are compared, so that the order of additions cannot decide a rank.
DIGITS = 6


def best(scored: DataFrame, k: int, by: str = "qid", id_: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank, ties by id; limited before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(id_))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(qid, id, score, rank) by cosine; queries (qid, vec), vectors (id, vec, ...); the filter comes first.

    Every task keeps the k best of its vectors for each query, so that no row stands for a pair. Queries
    are broadcast in blocks of ``nearest.BLOCK`` values; each block is a pass over the vectors.
    """
    if where is not None:
        vectors = vectors.where(where)
    spark = queries.sparkSession
    q = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"))
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    passes = max(1, -(-n * max(width or 0, k) // nearest.BLOCK))
    spread = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).repartition(spark.sparkContext.defaultParallelism)
    spread = spread.sortWithinPartitions("id")
    schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("id", spread.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    found = None
    for i in range(passes):
        part = q if passes == 1 else q.where(F.pmod(F.xxhash64("qid", "vec"), F.lit(passes)) == i)
        one = _searched(spread, part, k, schema)
        found = one if found is None else found.unionByName(one)
    return best(found, k)


def _searched(vectors: DataFrame, queries: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """(qid, id, score): the k best of each query in each partition of the sorted vectors."""
    table = queries.toArrow().combine_chunks()  # a block
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
    held = vectors.sparkSession.sparkContext.broadcast((columns[0], nearest.blocks_of(columns[1])))
    digits = DIGITS

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from nearest.search(batches, *held.value, k, digits, to_arrow_schema(schema))

    return vectors.mapInArrow(run, schema)


def sparse_topk(queries: DataFrame, postings: DataFrame, k: int, drop_ratio: float = 0.0) -> DataFrame:
    """(qid, id, score, rank) by inner product; queries (qid, token, w), postings (id, token, w).

    ``drop_ratio`` leaves out that share of each query's smallest weights (0: exact).
    """
    q = queries.select("qid", "token", F.col("w").alias("qw"))
    if drop_ratio:
        w = Window.partitionBy("qid").orderBy("qw", "token")
        share = (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy("qid"))
        q = q.withColumn("share", share).where(F.col("share") >= drop_ratio)
    met = postings.join(small_side(q.select("qid", "token", "qw")), "token")
    return best(met.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("qw")), DIGITS).alias("score")), k)


def rrf(arms: list[DataFrame], limit: int, k: int = 60, threshold: float = 0.0) -> DataFrame:
    """Reciprocal-rank fusion of arms (qid, id, rank), ranks from 1: (qid, id, score, rank)."""
    union = arms[0].select("qid", "id", "rank")
    for arm in arms[1:]:
        union = union.unionByName(arm.select("qid", "id", "rank"))
    fused = union.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    return best(fused.where(F.col("score") >= threshold), limit)


def hybrid_topk(dense_queries: DataFrame, vectors: DataFrame, sparse_queries: DataFrame, postings: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Dense and sparse arms of k each, fused."""
    return rrf([dense_topk(dense_queries, vectors, k), sparse_topk(sparse_queries, postings, k)], k, rrf_k)


def bm25_topk(queries: DataFrame, terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, id, score, rank); queries (qid, token), terms (id, token, tf) of all documents."""
    lengths = terms.groupBy("id").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    wanted = queries.select("qid", "token").distinct()
    met = terms.join(small_side(wanted.select("token").distinct()), "token", "left_semi")
    df = met.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    rows = met.join(F.broadcast(stats)).join(small_side(df), "token").join(lengths, "id").join(small_side(wanted), "token")
    return best(rows.groupBy("qid", "id").agg(F.round(F.sum(idf * part), DIGITS).alias("score")), k)


def similar_groups(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """Candidate groups within a partition (VEC13): (part, owner, members), groups of more than one.

    ``rows`` has part, id, and candidates (part, owner, id, score) are cut at ``threshold`` and at
    k per owner. Each member goes to the first owner, by id, that claims it.
    """
    ranked = best(rows.where(F.col("score") >= threshold).withColumn("qid", F.struct("part", "owner")), k)
    claimed = ranked.groupBy("part", "id").agg(F.min("owner").alias("owner"))
    groups = claimed.groupBy("part", "owner").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return groups.where(F.size("members") > 1)

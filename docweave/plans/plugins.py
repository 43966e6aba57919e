"""Plug points for remote models, with deterministic stand-ins (VEC7-9, FUS4, TRE11, QRW1-4, UDF1-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import rewrite_of
from docweave.operators.metrics import token_f1

Embed = Callable[[list[str]], list[list[float]]]


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in: counts of words by the hash of their bytes, of length one."""
    import math
    import zlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            v[zlib.crc32(w.encode()) % size] += 1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def embedded(df: DataFrame, text: str, embed: Embed = hashed_embedding, batch: int = 16, name: str = "vec") -> DataFrame:
    """A vector for each text, asked for in batches; null texts count as empty (VEC7-8)."""
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            s = s.fillna("")
            yield pd.Series([v for i in range(0, len(s), batch) for v in embed(s.iloc[i : i + batch].tolist())], index=s.index, dtype=object)

    return df.withColumn(name, run(text))


def embedded_cached(queries: DataFrame, cache: DataFrame, embed: Embed = hashed_embedding) -> DataFrame:
    """(pos, text, vec): cached vectors where there are some, others made (VEC9); cache has text, vec."""
    known = cache.dropDuplicates(["text"])
    hit = queries.join(known, "text")
    miss = embedded(queries.join(known, "text", "left_anti"), "text", embed)
    return hit.select("pos", "text", "vec").unionByName(miss.select("pos", "text", "vec"))


def overlap_scorer(query: Column, text: Column) -> Column:
    """A stand-in for a rerank model: F1 of the two token sets."""
    return token_f1(query, text)


def keyword_router(queries: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """A stand-in for clause routing: (qid, node_id) of the titles that share most words with a query."""
    score = token_f1(F.col("query"), F.col("title"))
    rows = queries.join(nodes.select("doc_id", "node_id", "title"), "doc_id").withColumn("score", score).where("score > 0")
    from docweave.operators.vector import best

    return best(rows.withColumnRenamed("node_id", "id"), most).select("qid", F.col("id").alias("node_id"), "score")


def rewritten(queries: DataFrame, mode: str = "unified", reply: Column | None = None) -> DataFrame:
    """(qid, n, query, intent) by mode: unified one query, hyde a passage, multi the query and its variants (QRW1-3).

    ``reply`` is the model's answer; without one, or if it cannot be read, the query stays and the
    intent is fact (QRW4).
    """
    if mode not in ("unified", "hyde", "multi"):
        raise ValueError(f"no such mode: {mode}")
    reply = F.lit(None).cast("string") if reply is None else reply
    if mode == "unified":
        r = rewrite_of(reply, F.col("query"))
        return queries.select("qid", F.lit(0).alias("n"), r["query"].alias("query"), r["intent"].alias("intent"))
    if mode == "hyde":
        return queries.select("qid", F.lit(0).alias("n"), F.coalesce(F.nullif(F.trim(reply), F.lit("")), "query").alias("query"), F.lit("fact").alias("intent"))
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return queries.select("qid", F.posexplode(F.concat(F.array("query"), lines)).alias("n", "query"), F.lit("fact").alias("intent"))


PIPELINES: dict[str, Callable] = {}


def register_pipeline(doc_type: str) -> Callable:
    """Register a function for a kind of document (UDF3)."""

    def add(f: Callable) -> Callable:
        PIPELINES[doc_type] = f
        return f

    return add

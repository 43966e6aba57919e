"""Fusion, rerank, merge and context assembly (FUS1-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rerank_dedup(hits: DataFrame, top_k: int | None = None) -> DataFrame:
    """One row per (qid, id): the last payload at the first position, by score and then position (FUS2).

    ``hits`` has qid, pos, id, payload, score (of that payload). A query with a blank text is
    passed by giving null scores: then position alone decides (FUS3).
    """
    one = hits.groupBy("qid", "id").agg(F.max_by(F.struct("payload", "score"), "pos").alias("last"), F.min("pos").alias("pos"))
    w = Window.partitionBy("qid").orderBy(F.col("last.score").desc_nulls_last(), F.asc("pos"))
    out = one.select("qid", "id", "last.payload", "last.score", "pos", F.row_number().over(w).alias("rank"))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def merge_chunks(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks of chosen clauses, then the first found chunk of each other clause, then those without (FUS5).

    Both have qid, pos, chunk_id, clause_id; clause -1 is none. Adds part (0, 1, 2) and the final pos.
    """
    first = chosen.withColumn("part", F.lit(0))
    others = found.where("clause_id <> -1").join(chosen.select("qid", "clause_id").distinct(), ["qid", "clause_id"], "left_anti")
    one = others.withColumn("n", F.row_number().over(Window.partitionBy("qid", "clause_id").orderBy("pos", "chunk_id"))).where("n = 1").drop("n").withColumn("part", F.lit(1))
    loose = found.where("clause_id = -1").withColumn("part", F.lit(2))
    out = first.unionByName(one).unionByName(loose)
    return out.withColumn("final", F.row_number().over(Window.partitionBy("qid").orderBy("part", "pos", "chunk_id")))


def relevant_tree(chosen: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outline of all nodes on the paths of results (FUS6): (qid, outline).

    ``chosen`` (qid, node_id) are nodes whose children without chunks are listed too; ``paths``
    (qid, clause_path) hold dotted ids or "N/A"; ``nodes`` has node_id, parent_id, level, title,
    content, n_chunks.
    """
    ids = paths.where("clause_path <> 'N/A'").select("qid", F.explode(F.split("clause_path", r"\.")).cast("bigint").alias("node_id"))
    bare = chosen.join(nodes.where("n_chunks = 0").select(F.col("node_id").alias("child"), F.col("parent_id").alias("node_id")), "node_id").select("qid", F.col("child").alias("node_id"))
    wanted = ids.unionByName(bare).distinct()
    line = F.concat(F.repeat(F.lit("#"), F.col("level") + 2), F.lit(" "), F.col("title"), F.when(F.length("content") > 0, F.concat(F.lit("\n"), F.col("content"))).otherwise(""))
    rows = wanted.join(nodes, "node_id").select("qid", "node_id", line.alias("line"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "line"))), lambda x: x["line"]), "\n").alias("outline"))


def ancestor_closure(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node_id) with all ancestors but the root (FUS7); ``nodes`` has node_id and path, and qid if each query has nodes of its own."""
    on = [c for c in ("qid", "node_id") if c in nodes.columns]
    return ids.join(nodes.select(*on, "path"), on).select("qid", F.explode("path").alias("node_id")).distinct()


def path_text(nodes, rels):
    """``a --REL--> b --REL--> c`` from an array of names and one of relations (FUS8)."""
    steps = F.transform(F.arrays_zip(F.slice(nodes, 2, F.size(rels)).alias("n"), rels.alias("r")), lambda x: F.concat(F.lit(" --"), x["r"], F.lit("--> "), x["n"]))
    return F.concat(F.element_at(nodes, 1), F.array_join(steps, ""))


def context_blocks(hits: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """(qid, context): numbered blocks of texts; with an outline only chunks without clause (FUS9).

    ``hits`` has qid, rank, text, clause_id; ``outlines`` (qid, outline).
    """
    rows = hits
    if outlines is not None:
        rows = rows.join(outlines, "qid", "left").where(F.col("outline").isNull() | (F.col("clause_id") == -1))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    block = F.format_string("[%d]\n%s", F.col("i"), F.col("text"))
    out = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
    if outlines is not None:
        out = outlines.join(out, "qid", "full_outer").select("qid", F.concat_ws("\n\n", "outline", "context").alias("context"))
    return out


def history_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, pair, qa): messages 2i and 2i + 1 of user and assistant; a missing answer is empty (FUS10)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.where(F.col("role") != "system").withColumn("n", F.row_number().over(w) - 1)
    pair = F.floor(F.col("n") / 2)
    rows = rows.groupBy("conv_id", pair.alias("pair")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("text"))).alias("q"), F.coalesce(F.max(F.when(F.col("n") % 2 == 1, F.col("text"))), F.lit("")).alias("a"))
    return rows.select("conv_id", "pair", F.concat(F.lit("Q: "), "q", F.lit("\nA: "), "a").alias("qa"))


def neighbour_text(chunks: DataFrame) -> DataFrame:
    """Chunks with the text of the chunk before and after (FUS11); has chunk_id, prev_id, next_id, text."""
    text = chunks.select(F.col("chunk_id").alias("cid"), F.col("text").alias("t"))
    prev, nxt = text.withColumnsRenamed({"cid": "prev_id", "t": "prev_text"}), text.withColumnsRenamed({"cid": "next_id", "t": "next_text"})
    out = chunks.join(prev, "prev_id", "left").join(nxt, "next_id", "left")
    return out.withColumn("text", F.concat_ws("\n", "prev_text", "text", "next_text")).drop("prev_text", "next_text")

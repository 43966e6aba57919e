"""Clause trees as flat node tables (TRE1-12, WIN3-5).

Nodes: doc_id, node_id (pre-order, from 1), parent_id (0 for the root), level 1-4, title, content,
page, path (ids from level 1 to the node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.windows import parents, ranges

# What a title of each level looks like, in the order in which they are tried.
TITLES = [
    (1, r"^(?:#+\s*|\*\*)?(?:.*?保险条款.*?（[^）]*）)"),
    (2, r"^(?:#+\s*|\*\*)?第[一二三四五六七八九十]+部分\s*[\S\s]+"),
    (3, r"^(?:#+\s*|\*\*)?(?:第[一二三四五六七八九十]+条|[一二三四五六七八九十]+、)\s*[\S\s]+"),
    (4, r"^(?:#+\s*|\*\*)?（[一二三四五六七八九十]+）\s*[\S\s]+"),
]


def classified(lines: DataFrame, text: str = "text", patterns: list[tuple[int, str]] = TITLES) -> DataFrame:
    """level (null if no title) and title of each line, by the first pattern that matches (TRE1)."""
    level, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, pattern in reversed(patterns):
        here = F.col(text).rlike(pattern)
        level, title = F.when(here, n).otherwise(level), F.when(here, F.regexp_extract(text, pattern, 0)).otherwise(title)
    return lines.withColumns({"level": level, "title": title})


def forest(lines: DataFrame) -> DataFrame:
    """Nodes from classified lines (doc_id, pos, page, text, level, title), pages numbered (TRE2-3).

    Lines before the first level-1 title are skipped, lines without a title are content of the
    title before them, level-1 nodes without children are dropped; ids are not renumbered.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.withColumn("seen", F.max(F.when(F.col("level") == 1, 1)).over(w)).where("seen = 1").drop("seen")
    rows = rows.withColumn("node_id", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "text")))), lambda x: x["text"]), "")
    nodes = rows.groupBy("doc_id", "node_id").agg(F.max("level").alias("level"), F.max("title").alias("title"), text.alias("content"), F.array_sort(F.collect_set("page")).alias("pages"))
    nodes = parents(nodes, ["doc_id"], "node_id", "level").withColumnRenamed("parent", "parent_id")
    kept = nodes.where("parent_id <> 0").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    lone = nodes.where("level = 1").join(kept, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id")
    return with_paths(nodes.join(lone, ["doc_id", "node_id"], "left_anti"))


def with_paths(nodes: DataFrame, keys: tuple[str, ...] = ("doc_id",), levels: int = 4) -> DataFrame:
    """path: ids from the top to the node (TRE6), by one self-join for each level."""
    link = nodes.select(*keys, F.col("node_id").alias("up"), F.col("parent_id").alias("above"))
    out = nodes.withColumns({"path": F.array("node_id"), "up": F.col("parent_id")})
    for _ in range(levels - 1):
        out = out.join(link, [*keys, "up"], "left").withColumn("path", F.when(F.col("up") > 0, F.concat(F.array("up"), F.col("path"))).otherwise(F.col("path"))).drop("up").withColumnRenamed("above", "up").fillna(0, ["up"])
    return out.drop("up")


def clause_path(path: Column) -> Column:
    """Dotted ids, "N/A" where there are none."""
    return F.coalesce(F.array_join(F.transform(path, lambda x: x.cast("string")), "."), F.lit("N/A"))


def subtree(nodes: DataFrame, node_id: Column | int) -> DataFrame:
    """A node with all below it (TRE7)."""
    return nodes.where(F.array_contains("path", node_id))


def tree_ranges(nodes: DataFrame, last_pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, start_page, end_page) of level-1 nodes (WIN5); last_pages (doc_id, last_page)."""
    tops = nodes.where("level = 1").select("doc_id", "node_id", F.element_at("pages", 1).alias("start_page")).join(last_pages, "doc_id")
    return ranges(tops, ["doc_id"], "start_page", "last_page").select("doc_id", "node_id", "start_page", F.col("end").alias("end_page"))


def outline(nodes: DataFrame, keys: list[str], content: bool = False) -> DataFrame:
    """(keys, outline): a markdown heading for each node, with its id and chunks (TRE9)."""
    line = F.format_string("%s %s [ID:%d] <%d chunks>", F.repeat(F.lit("#"), F.col("level") + 2), F.col("title"), F.col("node_id"), F.coalesce("n_chunks", F.lit(0)))
    if content:
        line = F.concat_ws("\n", line, F.nullif("content", F.lit("")))
    rows = nodes.select(*keys, "node_id", line.alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "line"))), lambda x: x["line"]), "\n").alias("outline"))


def chunk_ids(nodes: DataFrame, wanted: DataFrame, children: bool = False) -> DataFrame:
    """(doc_id, node_id, chunk_id) of wanted nodes, with those below if asked (TRE10); nodes have chunk_ids."""
    if not children:
        return nodes.join(wanted, ["doc_id", "node_id"]).select("doc_id", "node_id", F.explode("chunk_ids").alias("chunk_id"))
    below = nodes.select("doc_id", "chunk_ids", F.explode("path").alias("node_id"))
    return below.join(wanted, ["doc_id", "node_id"]).select("doc_id", "node_id", F.explode("chunk_ids").alias("chunk_id")).distinct()


def matched(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_id, page, text) with the node they belong to (TRE12).

    Candidates are the nodes on the chunk's page; 20 points if the chunk begins with the title, 5
    for each of its lines of more than one character in the content, and the level if any counts.
    Ties go to the smaller id; without points node_id is -1 and the path "N/A".
    """
    places = nodes.select("doc_id", "node_id", "level", "title", "content", "path", F.explode("pages").alias("page"))
    met = chunks.join(places, ["doc_id", "page"], "left")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    hits = F.size(F.filter(lines, lambda x: F.contains(F.col("content"), x)))
    points = F.when(F.startswith("text", F.col("title")), 20).otherwise(0) + 5 * hits
    met = met.withColumn("points", F.coalesce(points, F.lit(0))).withColumn("points", F.when(F.col("points") > 0, F.col("points") + F.col("level")).otherwise(0))
    best = met.groupBy("doc_id", "chunk_id").agg(F.max_by(F.struct("node_id", "path", "points"), F.struct("points", -F.col("node_id"))).alias("b"))
    some = F.col("b.points") > 0
    return best.select("doc_id", "chunk_id", F.when(some, F.col("b.node_id")).otherwise(-1).alias("node_id"), F.when(some, clause_path(F.col("b.path"))).otherwise("N/A").alias("clause_path"))

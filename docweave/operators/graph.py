"""Entity and relationship graphs (GRF1-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.shared import shared_base
from docweave.functions.text import cleaned, hashed_id
from docweave.operators.aggregates import degrees, joined, majority, merged_ids
from docweave.operators.joins import both_ends

# Marks of the records that a model writes.
RECORD_END, COMPLETE, TUPLE = "##", "<|COMPLETE|>", "<|>"
#: Characters of a name.
MAX_NAME = 180


def records(replies: DataFrame) -> DataFrame:
    """(doc_id, root_id, pos, parts): tuples in replies (doc_id, root_id, text), empty pieces dropped (GRF1)."""
    pieces = F.split(F.replace("text", F.lit(COMPLETE), F.lit(RECORD_END)), RECORD_END)
    rows = replies.select("doc_id", "root_id", F.posexplode(pieces).alias("pos", "r"))
    inside = F.regexp_extract("r", r"(?s)\((.*)\)", 1)
    parts = F.filter(F.transform(F.split(inside, r"<\|>"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("doc_id", "root_id", "pos", parts.alias("parts")).where(F.size("parts") >= 5)


def _part(i: int) -> Column:
    return cleaned(F.get("parts", F.lit(i)))


def entities(found: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Entity records as (doc_id, root_id, pos, name, type, description, clause_ids); types without case (FLT15)."""
    rows = found.where(_part(0) == "entity")
    ids = F.filter(F.transform(F.split(_part(4), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("doc_id", "root_id", "pos", F.substring(F.upper(_part(1)), 1, MAX_NAME).alias("name"), F.upper(_part(2)).alias("type"), _part(3).alias("description"), ids.alias("clause_ids"))
    return rows.where(F.lower("type").isin([t.lower() for t in types])) if types else rows


def relationships(found: DataFrame) -> DataFrame:
    """Relationship records as (doc_id, root_id, pos, src, dst, type, description)."""
    rows = found.where(_part(0) == "relationship")
    name = lambda i: F.substring(F.upper(_part(i)), 1, MAX_NAME)
    return rows.select("doc_id", "root_id", "pos", name(1).alias("src"), name(2).alias("dst"), F.upper(_part(3)).alias("type"), _part(4).alias("description"))


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One node for each name of a root: majority type, joined descriptions, united clause ids, hashed id (GRF3)."""
    keys = ["doc_id", "root_id", "name"]
    kinds = majority(rows, keys, "type", "pos")
    rest = rows.groupBy(*keys).agg(joined("description").alias("description"), merged_ids("clause_ids").alias("clause_ids"))
    return rest.join(kinds, keys).withColumn("id", hashed_id(*[F.col(k).cast("string") for k in keys]))


def merged_edges(rows: DataFrame) -> DataFrame:
    """One edge for each pair of names of a root (GRF4)."""
    keys = ["doc_id", "root_id", "src", "dst"]
    kinds = majority(rows, keys, "type", "pos")
    out = rows.groupBy(*keys).agg(joined("description").alias("description")).join(kinds, keys)
    return out.withColumn("id", hashed_id(*[F.col(k).cast("string") for k in [*keys, "type"]]))


def subgraph(nodes: DataFrame, edges: DataFrame, order: str = "id") -> DataFrame:
    """Edges whose ends exist, the last of parallel ones (GRF5); nodes have id, edges src, dst."""
    kept = both_ends(edges, nodes)
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return kept.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), order).alias("e")).select("src", "dst", "e.*")


def merged_graph(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], sep: str = "<SEP>") -> tuple[DataFrame, DataFrame]:
    """Two graphs as one (GRF6): descriptions appended, clause ids united, degree as rank.

    Nodes have id, name, type, description, clause_ids; edges src, dst, type, description.
    """
    a, b = old[0].alias("a"), new[0].alias("b")
    nodes = a.join(b, "id", "full_outer").select(
        "id",
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("name", "type")],
        F.concat_ws(sep, "a.description", "b.description").alias("description"),
        F.array_sort(F.array_union(F.coalesce("a.clause_ids", F.array().cast("array<string>")), F.coalesce("b.clause_ids", F.array().cast("array<string>")))).alias("clause_ids"),
    )
    c, d = old[1].alias("a"), new[1].alias("b")
    edges = c.join(d, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("a.type", "b.type").alias("type"), F.concat_ws(sep, "a.description", "b.description").alias("description"))
    nodes = nodes.join(degrees(edges), "id", "left").withColumn("rank", F.coalesce("degree", F.lit(0))).drop("degree")
    return nodes, edges


def _written(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder, so that an iteration does not grow the plan."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """(id, rank) with uniform restarts; nodes without edges out give to all (GRF7).

    Stops when the summed change is under tolerance times nodes, or after so many rounds.
    """
    n = max(nodes.count(), 1)
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = _written(links.join(out, "src"))
    ranks = _written(nodes.select("id").distinct().join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "out", F.lit(1.0 / n).alias("rank")))
    for i in range(rounds):
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = ranks.join(given, "id", "left").join(F.broadcast(lost)).select("id", "out", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("new"), "rank")
        last = i == rounds - 1
        if not last and (i + 1) % every:
            ranks = new.select("id", "out", F.col("new").alias("rank"))
            continue
        new = _written(new)
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] or 0.0
        ranks = new.select("id", "out", F.col("new").alias("rank"))
        if moved < n * tolerance:
            break
    return ranks.select("id", "rank")


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame | None = None, hops: int = 5, types: list[str] | None = None) -> DataFrame:
    """Directed simple paths of 1 to ``hops`` edges (GRF8-9): (src, dst, nodes, rels, length).

    Edges (src, dst, type, and the keys that both ends share, part); types are filtered first.
    """
    e = edges.where(F.col("type").isin(types)) if types else edges
    e = e.select("src", "dst", "type").distinct()
    at = starts.select(F.col("id").alias("src")).join(e, "src").where("src <> dst").select("src", "dst", F.array("src", "dst").alias("nodes"), F.array("type").alias("rels"))
    found = at
    for _ in range(hops - 1):
        step = e.select(F.col("src").alias("dst"), F.col("dst").alias("to"), "type")
        at = at.join(step, "dst").where(~F.array_contains("nodes", F.col("to"))).select("src", F.col("to").alias("dst"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("rels", F.array("type")).alias("rels"))
        found = found.unionByName(at)
    if ends is not None:
        found = found.join(ends.select(F.col("id").alias("dst")), "dst", "left_semi")
    return found.withColumn("length", F.size("rels"))


def evidence(found: DataFrame) -> DataFrame:
    """Paths with their class (GRF9): exclusion if any relation is NOT_INCLUDE, else coverage."""
    return found.withColumn("class", F.when(F.exists("rels", lambda r: r == "NOT_INCLUDE"), "exclusion").otherwise("coverage"))


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(id, hop) of all nodes within so many undirected hops (GRF10)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0))
    for i in range(hops):
        edge = seen.where(F.col("hop") == i).select(F.col("id").alias("src"))
        new = both.join(edge, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(i + 1))
        seen = seen.unionByName(new)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between given nodes."""
    return both_ends(edges, nodes)


def realigned(edges: DataFrame, mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (doc_id, root_id, src, dst, type) with replaced names led to every new one (GRF12).

    ``mapping`` (old, new) may give several; ends must exist among nodes (name), edges onto
    themselves go, ids are made anew.
    """
    for end in ("src", "dst"):
        edges = edges.join(mapping.select(F.col("old").alias(end), F.col("new").alias("_new")), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    edges = both_ends(edges.where("src <> dst"), nodes, "name")
    return edges.select("doc_id", "root_id", "src", "dst", "type").distinct().withColumn("id", hashed_id(*[F.col(c).cast("string") for c in ("doc_id", "root_id", "src", "dst", "type")]))


def edge_context(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, context): each node's edges out and in, sorted (GRF13)."""
    out = edges.select(F.col("src").alias("id"), F.struct(F.lit("out").alias("way"), "type", F.col("dst").alias("other")).alias("e"))
    into = edges.select(F.col("dst").alias("id"), F.struct(F.lit("in").alias("way"), "type", F.col("src").alias("other")).alias("e"))
    return out.unionByName(into).join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("e")).alias("context"))


def wide_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as rows of one table told apart by graph_type (GRF14)."""
    return nodes.withColumn("graph_type", F.lit("entity")).unionByName(edges.withColumn("graph_type", F.lit("relationship")), allowMissingColumns=True)

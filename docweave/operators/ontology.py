"""Vocabulary mapping, staging and decisions (ONT1-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.sized import small_side


def direct(maps: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, path_length 1, rels) of mapped pairs among the candidates (ONT1)."""
    out = maps.join(small_side(sources.select("source").distinct()), "source", "left_semi").join(small_side(targets.select("target").distinct()), "target", "left_semi")
    return out.select("source", "target", F.lit(1).alias("path_length"), F.array(F.lit("MAPS_TO")).alias("rels"))


def by_hops(maps: DataFrame, isa: DataFrame, sources: DataFrame, targets: DataFrame, hops: int = 5) -> DataFrame:
    """Mapped, then up to so many undirected ISA steps to a target; the shortest of each pair (ONT2).

    Steps go breadth first, so only the first visit of a node is followed.
    """
    both = isa.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = maps.join(small_side(sources.select("source").distinct()), "source", "left_semi").select("source", F.col("target").alias("node"), F.lit(0).alias("hop")).distinct()
    for i in range(hops):
        edge = seen.where(F.col("hop") == i)
        new = edge.join(both, edge.node == both.a).select("source", F.col("b").alias("node"), F.lit(i + 1).alias("hop")).distinct().join(seen, ["source", "node"], "left_anti")
        seen = seen.unionByName(new)
    out = seen.where("hop > 0").join(targets.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
    rels = F.concat(F.array(F.lit("MAPS_TO")), F.array_repeat(F.lit("ISA"), F.col("hop")))
    return out.select("source", F.col("node").alias("target"), (F.col("hop") + 1).alias("path_length"), rels.alias("rels"))


def aligned(maps: DataFrame, isa: DataFrame, sources: DataFrame, targets: DataFrame, hops: int = 5) -> DataFrame:
    """Direct pairs; only if there are none at all, pairs by hops."""
    found = direct(maps, sources, targets)
    return found if found.take(1) else by_hops(maps, isa, sources, targets, hops)


def thyroid_stage(age: Column, t: Column, n: Column, m: Column, histology: Column) -> Column:
    """AJCC 8 stage of a thyroid carcinoma (ONT3): prefixes p and c are dropped, case does not matter."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[pc]", ""))
    t, n, m = plain(t), plain(n), plain(m)
    has = F.contains
    spread = has(m, F.lit("m1"))
    young = F.when(spread, "II期").otherwise("I期")
    older = F.when(spread, "IVB期").when(has(t, F.lit("t4b")), "IVA期").when(has(t, F.lit("t4a")), "III期").when(has(t, F.lit("t3")) | has(n, F.lit("n1")), "II期").otherwise("I期")
    medullary = F.when(spread, "IVC期").when(has(t, F.lit("t4b")), "IVB期").when(has(t, F.lit("t4a")) | has(n, F.lit("n1b")), "IVA期").when(has(n, F.lit("n1a")), "III期").when(has(t, F.lit("t2")) | has(t, F.lit("t3")), "II期").otherwise("I期")
    anaplastic = F.when(spread, "IVC期").when(has(t, F.lit("t4")) | has(n, F.lit("n1")), "IVB期").otherwise("IVA期")
    differentiated = F.when(age < 55, young).otherwise(older)
    return F.when(histology.isin("papillary", "follicular"), differentiated).when(histology == "medullary", medullary).when(histology == "anaplastic", anaplastic).otherwise("无法判定")


def full_names(concepts: DataFrame, synonyms: DataFrame, tag: str = r"\([^)]+\)$") -> DataFrame:
    """Concepts with the synonyms that end in a tag, joined in source order (ONT4, JN12, AGG19); "" if none.

    Synonyms have concept_id, pos, name.
    """
    tagged = synonyms.where(F.col("name").rlike(tag)).groupBy("concept_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "; ").alias("fsn"))
    return concepts.join(tagged, "concept_id", "left").fillna("", ["fsn"])


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key (ONT5, SNK3)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def confirmed(chosen: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Chosen ids that are among the candidates (ONT6)."""
    return chosen.join(candidates.select(key).distinct(), key, "left_semi")


def merged_decision(old: str, new: str) -> Column:
    """The newer value unless it is empty (ONT7)."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def folded_decisions(events: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last non-empty value of each column over ordered events."""
    return events.groupBy(*keys).agg(*[F.max_by(v, F.when(F.coalesce(F.col(v), F.lit("")) != "", F.col(order))).alias(v) for v in values])


def claim_status(decision: Column) -> Column:
    """A claim's status by its decision (ONT8)."""
    return F.when(decision == "approve", "approved").when(decision == "reject", "rejected").otherwise("under_review")


def query_text(*parts: Column) -> Column:
    """Non-empty parts with single blanks between (ONT9)."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), " ")


def glossary(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Texts (id, text) with terms (term, meaning) that they hold explained behind them (ONT10)."""
    met = rows.join(small_side(terms), F.contains("text", F.col("term")))
    notes = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "meaning"))), lambda x: F.concat(x["term"], F.lit(": "), x["meaning"])), "; ").alias("notes"))
    return rows.join(notes, "id", "left").select("id", F.when(F.col("notes").isNotNull(), F.concat("text", F.lit(" ("), "notes", F.lit(")"))).otherwise(F.col("text")).alias("text"))

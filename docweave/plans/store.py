"""A vector table in a Parquet folder (VEC10, UDF10): created, filled, searched and dropped by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import predicates, vector
from docweave.sources import sinks


class VectorTable:
    """Rows (id, vec, other declared fields) at a path that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def exists(self) -> bool:
        fs, place = self._folder()
        return fs.exists(place)

    def create(self) -> None:
        """An empty table; one that exists stays as it is."""
        if not self.exists():
            self.spark.createDataFrame([], self.schema).write.parquet(self.path)

    def drop(self) -> None:
        fs, place = self._folder()
        fs.delete(place, True)

    def health(self) -> dict:
        return {"type": "parquet", "status": "ok" if self.exists() else "absent", "rows": self.rows().count()}

    def rows(self) -> DataFrame:
        """All rows; none if the table is absent (FLT7)."""
        return self.spark.read.schema(self.schema).parquet(self.path) if self.exists() else self.spark.createDataFrame([], self.schema)

    def insert(self, rows: DataFrame) -> None:
        """Append; the table is made with the first rows, undeclared fields are dropped (SNK1)."""
        self.create()
        sinks.insert(rows, self.path, self.rows().columns)

    def delete(self, conditions: dict) -> int:
        return sinks.delete(self.spark, self.path, conditions) if self.exists() else 0

    def update(self, conditions: dict, values: dict) -> None:
        sinks.update(self.spark, self.path, conditions, values)

    def get(self, value) -> DataFrame:
        return predicates.by_id(self.rows(), "id", value)

    def get_bulk(self, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
        return predicates.bulk(self.rows(), ids, "id", fields)

    def query(self, filters=None, fields: list[str] | None = None) -> DataFrame:
        out = self.rows().where(predicates.matching(filters))
        return predicates.typed(out, fields) if fields else out

    def search(self, queries: DataFrame, k: int, filters=None) -> DataFrame:
        """(qid, id, score, rank) for queries (qid, vec)."""
        return vector.dense_topk(queries, self.rows().where(predicates.matching(filters)), k)


def concept_candidates(entities: DataFrame, concepts: DataFrame, domains: dict[str, str], k: int = 3) -> DataFrame:
    """Vocabulary candidates of entities (VEC11): (entity, vocabulary, id, score, rank).

    Entities have entity, type, icd_vec (its Chinese term), snomed_vec (its English term); concepts
    id, vec, vocabulary, domain. SNOMED concepts must be of the domain that the type stands for.
    """
    domain = F.lit(None).cast("string")
    for kind, name in domains.items():
        domain = F.when(F.col("type") == kind, name).otherwise(domain)
    icd = vector.dense_topk(entities.select(F.col("entity").alias("qid"), F.col("icd_vec").alias("vec")), concepts.where("vocabulary = 'ICD10CN'"), k)
    parts = [icd.withColumn("vocabulary", F.lit("ICD10CN"))]
    for name in sorted(set(domains.values())):
        mine = entities.withColumn("_domain", domain).where(F.col("_domain") == name)
        found = vector.dense_topk(mine.select(F.col("entity").alias("qid"), F.col("snomed_vec").alias("vec")), concepts.where((F.col("vocabulary") == "SNOMED") & (F.col("domain") == name)), k)
        parts.append(found.withColumn("vocabulary", F.lit("SNOMED")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("qid").alias("entity"), "vocabulary", "id", "score", "rank")


def graph_evidence(matches: DataFrame, nodes: DataFrame, edges: DataFrame, start: str, types: list[str], top: int = 3, rrf_k: int = 60) -> DataFrame:
    """Evidence for matched entities (VEC12, GRF11): (qid, nodes, rels, length, class, clause_ids).

    Matches (qid, id, score) count if both arms could have ranked them within ``top``; paths lead
    from the entity of name ``start`` to them, at most 10 for each, shortest first.
    """
    from docweave.operators.graph import evidence, paths

    enough = matches.where(F.col("score") >= 2 / (rrf_k + top) - 1e-6)
    begin = nodes.where(F.col("name") == start).select("id")
    found = evidence(paths(edges, begin, enough.select("id").distinct(), types=types))
    ranked = vector.best(enough.join(found, enough.id == found.dst).select("qid", (-F.col("length")).alias("score"), F.col("nodes").alias("id"), "rels", "length", "class"), 10)
    ids = ranked.select("qid", F.col("id").alias("nodes"), "rels", "length", "class")
    clauses = ids.select("qid", "nodes", "rels", F.explode("nodes").alias("id")).join(nodes.select("id", "clause_ids"), "id").groupBy("qid", "nodes", "rels").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("clause_ids")))).alias("clause_ids"))
    return ids.join(clauses, ["qid", "nodes", "rels"])

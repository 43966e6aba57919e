"""The vector table, concept candidates and graph evidence."""

from __future__ import annotations

from docweave.plans import store


def test_table(spark, tmp_path):
    t = store.VectorTable(spark, str(tmp_path / "v"), "id bigint, vec array<double>, label string")
    assert not t.exists() and t.query({"label": "a"}).count() == 0 and t.delete({"id": 1}) == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", 9), (2, [0.0, 1.0], "b", 9), (3, [1.0, 1.0], "a", 9)], "id bigint, vec array<double>, label string, extra int")
    t.insert(rows)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid int, vec array<double>")
    assert [(r.id, r.rank) for r in t.search(q, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert [r.id for r in t.search(q, 5, {"label": "b"}).collect()] == [2]
    assert t.get(2).first().label == "b" and t.get_bulk(spark.createDataFrame([(1,), (9,)], "id bigint"), ["label"]).count() == 1
    t.update({"id": 2}, {"label": "c"})
    assert t.delete({"label": "a"}) == 2 and [r.label for r in t.query(None, ["label"]).collect()] == ["c"]
    assert t.health()["rows"] == 1
    t.drop()
    assert not t.exists()


def test_concepts(spark):
    entities = spark.createDataFrame([("cough", "symptom", [1.0, 0.0], [0.0, 1.0])], "entity string, type string, icd_vec array<double>, snomed_vec array<double>")
    concepts = spark.createDataFrame([(1, [1.0, 0.1], "ICD10CN", None), (2, [0.0, 1.0], "SNOMED", "Condition"), (3, [0.0, 1.0], "SNOMED", "Drug")], "id int, vec array<double>, vocabulary string, domain string")
    got = store.concept_candidates(entities, concepts, {"symptom": "Condition", "medicine": "Drug"})
    assert sorted((r.vocabulary, r.id) for r in got.collect()) == [("ICD10CN", 1), ("SNOMED", 2)]


def test_evidence(spark):
    nodes = spark.createDataFrame([(1, "cover", ["10"]), (2, "part", ["11"]), (3, "illness", [])], "id bigint, name string, clause_ids array<string>")
    edges = spark.createDataFrame([(1, 2, "INCLUDE"), (2, 3, "NOT_INCLUDE"), (1, 3, "ODD")], "src bigint, dst bigint, type string")
    matches = spark.createDataFrame([(7, 3, 2 / 61), (7, 2, 1 / 61)], "qid int, id bigint, score double")
    got = store.graph_evidence(matches, nodes, edges, "cover", ["INCLUDE", "NOT_INCLUDE"]).collect()
    assert [(r.nodes, r["class"], r.clause_ids) for r in got] == [([1, 2, 3], "exclusion", ["10", "11"])]

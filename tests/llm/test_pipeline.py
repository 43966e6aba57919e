"""The pipeline against its stages' plain versions."""

from __future__ import annotations

import duckdb

import corpus_pipeline
from docweave.llm import pii, quality
from docweave.llm.forced_bpe import default_vocabulary, load
from tests.llm import brute
from tests.llm.test_contracts import SF, table


def test_run(spark):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    source = dict(duckdb.sql(f"select doc_id, source from '{SF}/documents.parquet'").fetchall())
    docs = {d: t for d, t in table("documents").items() if not brute.quality(t)[5]}
    # 200 documents over 20 hosts: no line is in 20 distinct documents of a host
    assert max(map(list(source.values()).count, source.values())) < quality.MIN_DOCUMENTS
    docs = {d: docs[d] for d, (_, _, kept) in brute.near(docs).items() if kept}
    docs = {d: docs[d] for d, x in brute.decontaminate(docs, table("benchmark")).items() if not x[4]}
    assert set(got) == set(docs)
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_private(frame).collect()}
    t = load(default_vocabulary())
    for d, text in docs.items():
        assert [(x.kind, x.start, x.end) for x in spans[d] if x.kind in pii.KINDS] == brute.private(text)
        assert got[d] == t.encode(pii.sanitise(text, spans[d]), add_special_tokens=False).ids


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("KEPT_", __import__("pyspark").sql.functions.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stage_edges(spark):
    """Null, empty and long texts, ties, repeated rows, empty tables and clashing columns in every stage."""
    prose = " ".join(f"word{i}" for i in range(80))
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, prose), (3, prose), (4, prose), (5, "other " + prose), (5, "another " + prose), (5, "another " + prose), (6, long), (7, long + " end"), (8, "call me at a@b.org " + " ".join(f"x{i}" for i in range(60)))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, `odd.name` int, SPANS int"
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "k", 1, 2) for i, t in rows], schema)
    want = {
        "quality": [None, 3, 4, 5, 5, 5, 6, 7, 8],
        "near_duplicates": [None, 1, 2, 3, 6, 8],
        "decontamination": [None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8],
        "private": [None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8],
        "encode": [None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert sorted((r.doc_id for r in got.select("doc_id").collect()), key=lambda x: (x is not None, x)) == want[name], name
        assert name == "encode" or got.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
    twice = docs.where("doc_id = 5")  # ids repeat: the least text stays
    assert [r.text for r in corpus_pipeline.unique(spark, twice, SF).collect()] == ["another " + prose]


def test_one_pass_of_python_a_stage(spark):
    """A stage's tasks start a Python worker for each mapInArrow: rules and replacements share one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.rules, corpus_pipeline.private):
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, stage.__name__


def test_texts_are_rewritten_in_every_way(spark, monkeypatch):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{body(i)}\nshared line\n\nown{i} line\nshared  LINE", "h" if i % 2 else None) for i in range(50)] + [(90, None, "h"), (91, "", None)]
    docs = spark.createDataFrame(rows, "id int, `the text` string, source string")
    for limit in (200_000, 0):  # common lines are broadcast or joined
        got = {r.id: r for r in quality.apply_rules(docs, text="the text", rewrite=True, max_broadcast=limit).collect()}
        assert len(got) == 52 and got[0].common_lines == [1, 3]
        assert {i: r["the text"] for i, r in got.items()} == {i: quality.without_lines(t, got[i].common_lines) for i, t, _ in rows}
        assert got[0]["the text"] == f"{body(0)}\n\nown0 line" and got[0].n_common_words == 4
    rows = [(i, f"{' '.join(f'f{i}x{j}' for j in range(9))} zebra quagga mail{i % 2}@b.org okapi, tapir") for i in range(8)] + [(8, None), (9, "zebra alone")]
    docs = spark.createDataFrame(rows, "id int, text string")
    wants = {r.id: pii.sanitise(r.text, r.spans) for r in pii.find_private(docs, keep=["id", "text"]).collect()}
    assert any("<EMAIL>" in (t or "") for t in wants.values())
    for most in (pii.MAX_TERMS, 1):  # one block of terms or several
        monkeypatch.setattr(pii, "MAX_TERMS", most)
        got = pii.find_private(docs, keep=["id", "text"], rewrite=True)
        assert got.columns == ["id", "text", "spans"]
        assert {r.id: r.text for r in got.collect()} == wants

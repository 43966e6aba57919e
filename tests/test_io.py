"""Sources, sinks, streams, state, plug points and pipelines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.plans import pipelines, plugins
from docweave.sources import readers, sinks
from docweave.streaming import jobs, state


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\nbad\ty\n2\tz\tmore\n")
    rows = readers.delimited(spark, str(tmp_path / "a.tsv"), "id int, name string", skip_bad=True)
    assert [(r.id, r.name) for r in rows.collect()] == [(1, "x")]
    assert readers.delimited(spark, str(tmp_path / "a.tsv"), "id int, name string").count() == 3
    (tmp_path / "b.json").write_text('[{"q": "x", "ids": ["1"]}]')
    assert readers.json_lines(spark, str(tmp_path / "b.json"), "q string, ids array<string>", whole=True).first().ids == ["1"]
    (tmp_path / "c.md").write_text("# T\nx")
    assert readers.texts(spark, str(tmp_path / "c.md")).first().text == "# T\nx"
    assert readers.binary(spark, str(tmp_path), "*.md").first().length == 5
    names = spark.createDataFrame([("a.PDF", "text/plain"), ("x", "Text/Plain; charset=utf-8"), ("y", None)], "f string, t string")
    assert [r.p for r in names.select(readers.parser_of(F.col("f"), F.col("t")).alias("p")).collect()] == ["pdf", "text", None]
    assert readers.settings("a: ${X:-1}, b: ${Y}", {"Y": "2"}) == "a: 1, b: 2"
    assert readers.sample(spark.range(100), "id", 7).collect() == readers.sample(spark.range(100).repartition(5), "id", 7).collect()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "id int, v string, extra int")
    sinks.insert(rows, path, ["id", "v"])
    assert spark.read.parquet(path).columns == ["id", "v"]
    assert sinks.delete(spark, path, {"id": [1]}) == 1
    sinks.update(spark, path, {"id": 2}, {"v": "B"})
    sinks.upsert(spark.createDataFrame([(3, "C"), (4, "D")], "id int, v string"), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "B"), (3, "C"), (4, "D")]
    sinks.as_json(rows, f"{path}.json")
    sinks.as_csv(rows, f"{path}.csv", ["v", "id"])
    assert spark.read.csv(f"{path}.csv", header=True).columns == ["v", "id"]
    many = spark.range(250).withColumn("v", F.col("id"))
    counts = sinks.import_rows(many, "id", F.when(F.col("id") % 50 == 7, "seven"), f"{path}-good", f"{path}-bad", batch=100, start=1)
    assert sorted(map(tuple, counts.collect())) == [(1, 98, 2), (2, 49, 1)]
    assert spark.read.parquet(f"{path}-good").count() == 147


def test_import_of_many_ranges(spark, tmp_path):
    """Batches are numbered through all ranges of the order, nulls last, and the sinks hold what is counted."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        id_ = F.when(F.col("id") < 20_000, (F.col("id") * 7_919) % 20_000)
        many = spark.range(20_050, numPartitions=4).select(id_.alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        counts = sinks.import_rows(many, "id", F.when((F.col("id") % 50 == 7) & (F.length("v") == 64), "seven"), str(tmp_path / "good"), str(tmp_path / "bad"), start=1)
        got = sorted(map(tuple, counts.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(b, 98, 2) for b in range(1, 200)] + [(200, 50, 0)]
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.csv(str(tmp_path / "bad"), header=True)
    assert (good.count(), good.distinct().count(), good.agg(F.min("id")).first()[0]) == (98 * 199 + 50, 98 * 199 + 50, 100)
    assert (bad.count(), bad.distinct().count()) == (2 * 199, 2 * 199)


def test_graph_sinks(spark):
    nodes = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2")], "id string, doc_id string")
    edges = spark.createDataFrame([("a", "b", "INCLUDE"), ("b", "c", "ODD"), ("a", "x", "INCLUDE")], "src string, dst string, type string")
    stored = sinks.stored_edges(edges, nodes, ["INCLUDE"])
    assert sorted((r.type, r.rel_type) for r in stored.collect()) == [("INCLUDE", None), ("RELATED_TO", "ODD")]
    left, kept, counts = sinks.without_document(nodes, edges, "d2")
    assert (left.count(), kept.count(), tuple(counts.first())) == (2, 2, (1, 1))
    mine, between = readers.subgraph_of(nodes, stored, "d1", ["INCLUDE", "ODD"])
    assert (mine.count(), between.count()) == (2, 1)


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "job int, at int, step string")
    work = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")  # noqa: E731  the same batch gives the same folder
    rows.write.parquet(source)
    for _ in range(2):  # the second call finds nothing new
        jobs.ingest(spark, source, "job int, at int, step string", work, str(tmp_path / "check")).awaitTermination()
    got = jobs.latest(spark.read.parquet(out), "job", "at", ["step"])
    assert sorted((r.job, r.step) for r in got.collect()) == [(1, "b"), (2, "c")]
    assert [r.s for r in spark.createDataFrame([(None,), (-1,), (0,), (3,), (7,)], "n int").select(jobs.status(F.col("n")).alias("s")).collect()] == ["not_found", "failed", "pending", "started", "finished"]


def test_state(spark):
    events = spark.createDataFrame([("t", "main", 1, "a", "1"), ("t", "main", 2, "b", "2"), ("t", "main", 3, "a", ""), ("t", "main", 4, "a", "4")], "thread string, branch string, seq int, key string, value string")
    assert state.state_at(events).first().state == {"a": "4", "b": "2"}
    assert state.state_at(events, 3).first().state == {"a": "1", "b": "2"}
    forked = events.unionByName(state.fork(events, "main", 2, "alt"))
    assert {r.branch: r.state["a"] for r in state.state_at(forked).collect()} == {"main": "4", "alt": "1"}
    assert state.checkpoints(events, "t", 2).count() == 2
    with pytest.raises(ValueError):
        state.checkpoints(events, "t", 0)


def test_plugins(spark):
    queries = spark.createDataFrame([(0, "a b"), (1, "c"), (2, None)], "pos int, text string")
    made = plugins.embedded(queries, "text")
    assert {len(r.vec) for r in made.collect()} == {64}
    cache = spark.createDataFrame([("c", [1.0])], "text string, vec array<double>")
    assert {r.pos: len(r.vec) for r in plugins.embedded_cached(queries.where("text is not null"), cache).collect()} == {0: 64, 1: 1}
    q = spark.createDataFrame([(1, "old", '{"query": "new", "intent": "logic"}')], "qid int, query string, r string")
    assert tuple(plugins.rewritten(q, "unified", F.col("r")).first())[2:] == ("new", "logic")
    assert [r.query for r in plugins.rewritten(q, "multi", F.lit("x\n\ny")).orderBy("n").collect()] == ["old", "x", "y"]
    assert plugins.rewritten(q).first().query == "old"
    with pytest.raises(ValueError):
        plugins.rewritten(q, "odd")


def test_search(spark):
    chunks = spark.createDataFrame([(1, "red apple pie", 5, "d"), (2, "green pear", 7, "d"), (3, "red pear", -1, "d"), (4, "red apple", 5, "other")], "chunk_id bigint, text string, clause_id int, doc_id string")
    queries = spark.createDataFrame([(1, "red apple"), (2, " ")], "qid int, query string")
    got = pipelines.search(queries, chunks, 3, {"doc_id": "d"}).orderBy("final").collect()
    assert got[0].chunk_id == 1 and {r.qid for r in got} == {1} and got[-1].clause_id == -1
    chosen = spark.createDataFrame([(1, 7)], "qid int, clause_id int")
    assert pipelines.search(queries, chunks, 3, {"doc_id": "d"}, chosen).orderBy("final").first().chunk_id == 2


def test_ingest(spark):
    pages = spark.createDataFrame([("d", 1, "甲保险条款（A）\n\n" + "第一部分 总则" + "说明" * 60), ("d", 2, "第一条 范围\n\n内容" + "很长" * 60), ("e", 1, "")], "doc_id string, page int, text string")
    out = plugins.PIPELINES["policy"](pages)
    assert {r.doc_id: r.verdict for r in out["quality"].collect()} == {"d": "ok", "e": "fail"}
    assert out["nodes"].count() == 3
    assert out["chunks"].count() >= 1

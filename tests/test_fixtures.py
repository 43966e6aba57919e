"""Hand-checked examples of operators."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions import vectors
from docweave.operators import aggregates, extraction, fusion, graph, metrics, ontology, tree, vector, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rrf(spark):
    arm = lambda ids: frame(spark, [(1, x, i + 1) for i, x in enumerate(ids)], "qid int, id string, rank int")
    got = {r.id: r.score for r in vector.rrf([arm("abc"), arm("bda")], 10).collect()}
    assert got == pytest.approx({"b": 0.032522475, "a": 0.032266458, "d": 0.016129032, "c": 0.015873016}, abs=1e-9)
    swapped = {r.id: r.score for r in vector.rrf([arm("bda"), arm("abc")], 10).collect()}
    assert swapped == got


def test_cosine(spark):
    rows = frame(spark, [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(vectors.cosine("a", "b").alias("c")).collect()] == [1.0, 0.0]
    with pytest.raises(Exception, match="length"):
        frame(spark, [([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.cosine("a", "b")).collect()


def test_sparse_drop_ratio(spark):
    q = frame(spark, [(1, 1, 1.0), (1, 2, 5.0)], "qid int, token int, w double")
    p = frame(spark, [(7, 1, 9.0), (8, 2, 1.0)], "id int, token int, w double")
    assert [(r.id, r.score) for r in vector.sparse_topk(q, p, 5).orderBy("rank").collect()] == [(7, 9.0), (8, 5.0)]
    assert [r.id for r in vector.sparse_topk(q, p, 5, drop_ratio=0.5).collect()] == [8]


def test_rerank_dedup(spark):
    hits = frame(spark, [(1, 0, "x", "p1", 0.5), (1, 1, "y", "p2", 0.5), (1, 2, "x", "p3", 0.5)], "qid int, pos int, id string, payload string, score double")
    assert [(r.id, r.payload, r.pos) for r in fusion.rerank_dedup(hits).orderBy("rank").collect()] == [("x", "p3", 0), ("y", "p2", 1)]


def test_merge_chunks(spark):
    schema = "qid int, pos int, chunk_id string, clause_id int"
    got = fusion.merge_chunks(frame(spark, [(1, 0, "f", 5)], schema), frame(spark, [(1, 0, "a", 5), (1, 1, "b", 7), (1, 2, "c", 7), (1, 3, "d", -1)], schema))
    assert [r.chunk_id for r in got.orderBy("final").collect()] == ["f", "b", "d"]


def test_metrics(spark):
    q = frame(spark, [(1,)], "qid int")
    got = frame(spark, [(1, 1, "x"), (1, 2, "a"), (1, 3, "y"), (1, 4, "b")], "qid int, rank int, id string")
    rel = frame(spark, [(1, "a"), (1, "b"), (1, "c")], "qid int, id string")
    m = metrics.metrics(q, got, rel, 3).first()
    assert (m.mrr, m.hit_rate, round(m.precision, 4), round(m.recall, 4), round(m.ndcg, 6)) == (0.5, 1.0, 0.3333, 0.3333, 0.296082)
    f1 = one(spark, metrics.token_f1(F.lit("a b c"), F.lit("a b d e")))
    assert round(f1, 6) == 0.571429


def test_percentile(spark):
    r = aggregates.percentile(frame(spark, [(v,) for v in (4, 1, 3, 2)], "v int"), [], "v", [50, 95]).first()
    assert (r.p50, r.p95) == (3, 4)


def test_majority_and_gate(spark):
    rows = frame(spark, [(1, i, t) for i, t in enumerate("XYYX")], "k int, pos int, t string")
    assert aggregates.majority(rows, ["k"], "t", "pos").first().t == "X"
    pages = frame(spark, [("d", "x" * 200)] + [("d", " ")] * 9, "doc_id string, text string")
    r = aggregates.parse_quality(pages).first()
    assert (r.empty_ratio, r.verdict) == (0.9, "fail")


def test_pagerank(spark):
    nodes, edges = frame(spark, [(x,) for x in "abc"], "id string"), frame(spark, [("a", "c"), ("b", "c")], "src string, dst string")
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, tolerance=1e-9).collect()}
    assert got == pytest.approx({"a": 0.212766, "b": 0.212766, "c": 0.574468}, abs=1e-5)
    assert sum(got.values()) == pytest.approx(1)


def test_ids(spark):
    lit = lambda *xs: tx.hashed_id(*map(F.lit, xs))
    assert one(spark, lit("doc1", "3", "保险责任")) == 482682847292806718
    assert one(spark, lit("doc1", "3", "A", "B", "INCLUDE")) == 915862092793780383
    assert one(spark, lit("doc1", None)) is None
    assert one(spark, tx.content_id(F.lit("abc"), F.lit(""))) == "44bc2cf5ad770999"


def test_confidence(spark):
    source = lambda s, kv: one(spark, extraction.source_confidence(F.lit(s), F.lit(True), F.lit(kv)))
    a, b = (source(s, kv) * 0.3 + 0.3 + 0.4 for s, kv in (("content_regex", 0), ("grid_fallback", 4)))
    assert (round(a, 3), round(b, 3)) == (0.985, 0.97)
    r = extraction.overall_confidence(frame(spark, [("d", "x", a), ("d", "y", b)], "doc_id string, field string, confidence double"), 7).first()
    assert round(r.overall, 6) == 0.769964


def test_converters(spark):
    rows = frame(spark, [("2,284.00", "2025年08月04日", "x", "")], "a string, b string, c string, d string")
    r = rows.select(tx.converted(F.col("a"), "decimal"), tx.converted(F.col("b"), "date"), tx.converted(F.col("c"), "date"), tx.converted(F.col("d"), "string")).first()
    assert tuple(r) == (Decimal("2284.00"), datetime.date(2025, 8, 4), None, None)


def test_stages(spark):
    rows = [("papillary", 54, "T1", "N0", "M1"), ("papillary", 55, "pT4a", "N0", "M0"), ("medullary", 1, "T1", "N1b", "M0"), ("anaplastic", 1, "T4", "N0", "M0"), ("other", 1, "", "", "")]
    got = frame(spark, rows, "h string, a int, t string, n string, m string").select(ontology.thyroid_stage(*map(F.col, "atnmh")).alias("s"))
    assert [r.s for r in got.collect()] == ["II期", "III期", "IVA期", "IVB期", "无法判定"]


def test_paths(spark):
    edges = frame(spark, [("责任", "A", "INCLUDE"), ("A", "B", "NOT_INCLUDE"), ("B", "责任", "INCLUDE")], "src string, dst string, type string")
    got = graph.evidence(graph.paths(edges, frame(spark, [("责任",)], "id string"), frame(spark, [("B",)], "id string"))).collect()
    assert [(r["class"], r.length) for r in got] == [("exclusion", 2)]
    shown = fusion.path_text(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("R"), F.lit("S")))
    assert one(spark, shown) == "a --R--> b --S--> c"


LINES = [("d", 1, "before"), ("d", 1, "甲保险条款（A）"), ("d", 1, "第一部分 总则"), ("d", 2, "第一条 范围"), ("d", 2, "内容"), ("d", 3, "第二条 责任"), ("d", 4, "第二部分 其他"), ("e", 1, "乙保险条款（B）")]


def test_forest(spark):
    lines = frame(spark, [(d, i, p, t) for i, (d, p, t) in enumerate(LINES)], "doc_id string, pos bigint, page int, text string")
    nodes = tree.forest(tree.classified(lines))
    got = {r.node_id: r for r in nodes.collect()}
    assert {i: r.parent_id for i, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 1}
    assert {i: ".".join(map(str, r.path)) for i, r in got.items()} == {1: "1", 2: "1.2", 3: "1.2.3", 4: "1.2.4", 5: "1.5"}
    assert got[3].content == "内容" and {r.doc_id for r in got.values()} == {"d"}
    last = frame(spark, [("d", 6)], "doc_id string, last_page int")
    assert [(r.start_page, r.end_page) for r in tree.tree_ranges(nodes, last).collect()] == [(1, 6)]
    chunks = frame(spark, [("d", "c1", 2, "第一条 范围\n内容"), ("d", "c2", 9, "none")], "doc_id string, chunk_id string, page int, text string")
    assert {r.chunk_id: r.clause_path for r in tree.matched(chunks, nodes).collect()} == {"c1": "1.2.3", "c2": "N/A"}


def test_ranges(spark):
    starts = frame(spark, [("d", 1, 6), ("d", 4, 6)], "doc_id string, start int, last int")
    assert sorted((r.start, r.end) for r in windows.ranges(starts, ["doc_id"], "start", "last").collect()) == [(1, 3), (4, 6)]


def test_versions_and_decisions(spark):
    old = frame(spark, [("P", "A", 1), ("Q", "A", 1)], "policy string, status string, v int")
    got = extraction.replaced(old, frame(spark, [("P", 2)], "policy string, v int"), "policy")
    assert sorted(map(tuple, got.collect())) == [("P", "A", 2), ("P", "I", 1), ("Q", "A", 1)]
    events = frame(spark, [(1, 1, "C73", "n", "I"), (1, 2, "", "m", "")], "k int, seq int, a string, b string, c string")
    assert tuple(ontology.folded_decisions(events, ["k"], "seq", ["a", "b", "c"]).first())[1:] == ("C73", "m", "I")


def test_records(spark):
    text = '("entity"<|>"保险责任"<|>"clause"<|>"desc"<|>"1, 2")##("relationship"<|>"保险责任"<|>"疾病"<|>"include"<|>"covers")<|COMPLETE|>'
    found = graph.records(frame(spark, [("doc1", 3, text)], "doc_id string, root_id int, text string"))
    n = graph.merged_nodes(graph.entities(found)).first()
    assert (n.name, n.type, n.clause_ids, n.id) == ("保险责任", "CLAUSE", ["1", "2"], 482682847292806718)
    e = graph.merged_edges(graph.relationships(found)).first()
    assert (e.src, e.dst, e.type) == ("保险责任", "疾病", "INCLUDE")


HTML = """<table><tr><th>保险项目</th><th>最高保险金额（元）</th></tr><tr><td rowspan="2">甲</td><td>2,000,000</td></tr><tr><td>5</td></tr></table>
<table><tr><td>投保人</td><td>Ellen Liu</td><td>性别</td><td>女</td><td>tail</td></tr></table>"""


def test_tables(spark):
    cells = extraction.table_cells(frame(spark, [("d", 1, HTML)], "doc_id string, page int, text string"))
    kinds = extraction.table_kinds(cells, {"coverage": ["保险项目"]})
    rows = sorted((r.row, r.name, r.value) for r in extraction.list_rows(cells, kinds).collect())
    assert rows == [(0, "保险项目", "甲"), (0, "最高保险金额（元）", "2,000,000"), (1, "最高保险金额（元）", "5")]
    pairs = {r.name: r.value for r in extraction.key_values(cells.where("tbl = 1"), ["ignored"]).collect()}
    assert pairs == {"投保人": "Ellen Liu", "性别": "女"}


def test_chunks(spark):
    pages = frame(spark, [("d", 1, "# A\nx"), ("d", 2, "y\n## B\nz")], "doc_id string, page int, text string")
    got = windows.carried_page(extraction.heading_chunks(pages), ["doc_id"], "pos").orderBy("pos").collect()
    assert [r.text for r in got if r.text] == ["# A\nx\ny", "## B\nz"] or [r.text.strip() for r in got if r.text] == ["# A\nx\n\ny", "## B\nz"]
    assert not any("[PAGE" in r.text for r in got)


def test_spans(spark):
    rows = frame(spark, [(1, 0, 5, 0.9), (1, 3, 8, 0.8), (1, 6, 9, 0.7)], "k int, start int, end int, score double")
    assert [(r.start, r.end) for r in windows.without_overlaps(rows, ["k"]).collect()] == [(0, 5), (6, 9)]
    touching = frame(spark, [(1, 0, 2, "a", "ab", True), (1, 2, 4, "b", "cd", True), (1, 4, 6, "c", "ef", True)], "k int, start int, end int, label string, text string, mergeable boolean")
    assert sorted((r.start, r.text) for r in windows.combined(touching, ["k"]).collect()) == [(0, "abcd"), (4, "ef")]


def test_text(spark):
    assert one(spark, tx.json_of(F.lit('noise ```json\n{"a": 1, // c\n "b": {"c": "}"}}``` tail'))) == '{"a": 1, "b": {"c": "}"}}'
    assert one(spark, tx.json_of(F.lit("none"))) == "{}"
    assert one(spark, tx.id_list(F.lit('x "relevant_clause_ids": [3, 14]'))) == [3, 14]
    assert tuple(one(spark, tx.rewrite_of(F.lit('{"query": " ", "intent": "odd"}'), F.lit("q")))) == ("q", "fact")
    assert one(spark, tx.repaired_json(F.lit('{1: "a", 2: "b"}'))) == '{"1": "a", "2": "b"}'
    assert one(spark, tx.filled("a {{ x }} b", x=F.lit("$1"))) == "a $1 b"
    assert one(spark, tx.sanitised_name(F.lit("a/b:c.txt"))) == "a_b_c.txt"
    assert len(one(spark, tx.sanitised_name(F.lit("x" * 300 + ".txt")))) == 255
    assert one(spark, tx.cleaned(F.lit(' "a &amp; b"\n'))) == "a & b"
    assert one(spark, tx.reply_lines(F.lit("<think>t</think>a\n\n\"b\""))) == ["a", "b"]


def test_history(spark):
    rows = frame(spark, [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2")], "conv_id int, turn int, role string, text string")
    assert [r.qa for r in fusion.history_pairs(rows).orderBy("pair").collect()] == ["Q: q1\nA: a1", "Q: q2\nA: "]


def test_glossary_and_alignment(spark):
    rows, terms = frame(spark, [(1, "the CT scan"), (2, "none")], "id int, text string"), frame(spark, [("CT", "computed tomography")], "term string, meaning string")
    assert sorted(r.text for r in ontology.glossary(rows, terms).collect()) == ["none", "the CT scan (CT: computed tomography)"]
    maps = frame(spark, [("i", "s1")], "source string, target string")
    isa = frame(spark, [("s1", "s2"), ("s3", "s2")], "child string, parent string")
    far = ontology.aligned(maps, isa, maps.select("source"), frame(spark, [("s3",)], "target string"))
    assert [(r.target, r.path_length) for r in far.collect()] == [("s3", 3)]
    near = ontology.aligned(maps, isa, maps.select("source"), frame(spark, [("s1",), ("s3",)], "target string"))
    assert [(r.target, r.path_length) for r in near.collect()] == [("s1", 1)]

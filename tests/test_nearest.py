"""Dense search and its metrics: no row for a pair, odd vectors, ties, several passes."""

from __future__ import annotations

import random

import duckdb
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docweave.functions import nearest
from docweave.functions.vectors import clipped, dot, norm
from docweave.operators import vector

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [nearest.BLOCK, 100])
def test_topk_of_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    pick = random.Random(1)
    vectors = [(f"v{i:05}", [float(pick.randint(-1, 1)) for _ in range(4)], i % 3) for i in range(5_000)]
    vectors += [("n", None, 0), (None, [1.0, 1.0, 1.0, 1.0], 0), ("a", [], 0), ("w", [1.0, 0.0], 0), ("x", [1.0, None, 0.0, 0.0], 0), ("y", [float("nan")] * 4, 0), ("z", [float("inf"), 0.0, 0.0, 1.0], 0), ("t", [1e-200] * 4, 0)]
    queries = [(i, [pick.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, 2.0]), (63, [1.0, 1.0, 0.0, 0.0]), (64, [])]
    v = spark.createDataFrame(vectors, "id string, vec array<double>, label int").repartition(3)
    q = spark.createDataFrame(queries, "qid int, vec array<double>")
    pairs = v.where("label < 2").join(q.select("qid", F.col("vec").alias("qvec")), how="cross")
    want = vector.best(pairs.select("qid", "id", F.round(clipped(dot("qvec", "vec"), norm("qvec"), norm("vec")), 6).alias("score")), 7)
    got = vector.dense_topk(q, v, 7, F.col("label") < 2)
    assert got.columns == want.columns == ["qid", "id", "score", "rank"]
    key = lambda r: (r.qid, r["rank"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert vector.dense_topk(q.limit(0), v, 7).count() == vector.dense_topk(q, v.limit(0), 7).count() == 0


def test_few_vectors_and_half(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id int, vec array<float>")
    assert [tuple(r) for r in vector.dense_topk(v.withColumnRenamed("id", "qid").where("qid = 1"), v, 5).orderBy("rank").collect()] == [(1, 1, 1.0, 1), (1, 2, 0.707107, 2)]
    assert nearest.half_up(nearest.np.array([0.5, -0.5, 1.5, -1e-9]), 0).tolist() == [1.0, -1.0, 2.0, 0.0]


def test_no_row_for_a_pair(spark):
    text = plan(__spark_entry__.queries()["vec_dense_topk"](spark, SF))
    assert "Join" not in text


def test_metrics_over_queries_with_relevant_items(spark, tmp_path):
    """Label 7 has one vector, a query: it has nothing relevant, and the SQL leaves it out."""
    spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("label", F.expr("case vec_id when 20 then 7 else vec_id % 3 end")).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = __spark_entry__.queries()["metrics_at_k"](spark, str(tmp_path))
    assert "Join Cross" not in plan(df) and "Join Inner\n" not in plan(df)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(df.columns)} from ({__spark_entry__.oracle_sql()['metrics_at_k']})").fetchall()[0]
    assert tuple(df.first()) == pytest.approx(want, abs=1e-9)

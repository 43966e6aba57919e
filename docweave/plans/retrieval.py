"""Queries over vectors, terms, fused ranks, metrics and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.vectors import cosine
from docweave.operators import fusion, metrics, predicates, vector
from docweave.plans.registry import Tables, query

TOP = 10
#: Searches take every row whose id is divisible by this as a query, against all rows.
EACH = 20
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def embeddings(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return v.where(F.col("id") % EACH == 0).select(F.col("id").alias("qid"), "vec", F.col("label").alias("qlabel")), v


def term_rows(df: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """(id, token, tf) of lower-case words of a-z."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return df.select(F.col(id_).alias("id"), F.explode(words).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def letter_profile(text: str):
    """A dense stand-in for an embedding: counts of the letters a-z."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


TERMS_SQL = """terms as (select id, token, count(*) as tf from (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) group by 1, 2),
qterms as (select qid, token, count(*) as qf from (select item_id as qid, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from benchmark where item_id % 20 = 0) group by 1, 2)"""
PROFILE_SQL = "[" + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::double" for c in LETTERS) + "]"
DENSE_SQL = """q as (select vec_id as qid, embedding::double[] as qv, label as qlabel from embeddings where vec_id % 20 = 0),
v as (select vec_id as id, embedding::double[] as vec, label from embeddings),
dense as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from (select qid, qlabel, id, label, round(list_cosine_similarity(qv, vec), 6) as score from q, v {where})) where rank <= 10)"""


@query("vec_dense_topk", f"with {DENSE_SQL.format(where='')} select qid, id, score, rank::int as rank from dense")
def dense(spark, sf):
    q, v = embeddings(Tables(spark, sf))
    return vector.dense_topk(q, v, TOP)


@query("vec_dense_filtered", f"with {DENSE_SQL.format(where='where label in (1, 2, 3)')} select qid, id, score, rank::int as rank from dense")
def dense_filtered(spark, sf):
    q, v = embeddings(Tables(spark, sf))
    return vector.dense_topk(q, v, TOP, predicates.matching({"label": [1, 2, 3]}))


@query("vec_cosine_neighbours", "select a.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark, sf):
    _, v = embeddings(Tables(spark, sf))
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return v.join(nxt, "id").select("id", F.round(cosine("vec", "other"), 6).alias("score"))


def sparse_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = term_rows(t.documents, "doc_id").select("id", "token", F.col("tf").cast("double").alias("w"))
    q = term_rows(t.benchmark.where(F.col("item_id") % EACH == 0), "item_id").select(F.col("id").alias("qid"), "token", F.col("tf").cast("double").alias("w"))
    return q, p


SPARSE_SQL = "sparse as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from (select qid, id, sum(tf * qf)::double as score from terms join qterms using (token) group by 1, 2)) where rank <= 10)"


@query("vec_sparse_topk", f"with {TERMS_SQL}, {SPARSE_SQL} select qid, id, score, rank::int as rank from sparse")
def sparse(spark, sf):
    return vector.sparse_topk(*sparse_inputs(Tables(spark, sf)), TOP)


HYBRID_SQL = f"""with {TERMS_SQL}, {SPARSE_SQL},
q as (select item_id as qid, {PROFILE_SQL} as qv from benchmark where item_id % 20 = 0), v as (select doc_id as id, {PROFILE_SQL} as vec from documents),
dense as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from (select qid, id, round(coalesce(case when isnan(list_cosine_similarity(qv, vec)) then 0 else list_cosine_similarity(qv, vec) end, 0), 6) as score from q, v)) where rank <= 10),
fused as (select qid, id, round(sum(1.0::double / (60 + rank)), 9) as score from (select qid, id, rank from dense union all select qid, id, rank from sparse) group by 1, 2)"""
FUSED_SQL = "(select *, row_number() over (partition by qid order by score desc, id) as rank from fused)"


def hybrid_hits(t: Tables) -> DataFrame:
    q, p = sparse_inputs(t)
    dq = t.benchmark.where(F.col("item_id") % EACH == 0).select(F.col("item_id").alias("qid"), letter_profile("text").alias("vec"))
    return vector.hybrid_topk(dq, t.documents.select(F.col("doc_id").alias("id"), letter_profile("text").alias("vec")), q, p, TOP)


@query("vec_hybrid_rrf", f"{HYBRID_SQL} select qid, id, score, rank::int as rank from {FUSED_SQL} where rank <= 10")
def hybrid(spark, sf):
    return hybrid_hits(Tables(spark, sf))


@query(
    "search_context",
    f"""{HYBRID_SQL}, hits as (select * from {FUSED_SQL} where rank <= 10)
select qid, string_agg('[' || rank || ']' || chr(10) || text, chr(10) || chr(10) order by rank) as context from hits join documents on doc_id = id group by 1""",
)
def search_context(spark, sf):
    """Flagship: hybrid search, fused ranks, numbered context blocks."""
    t = Tables(spark, sf)
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    return fusion.context_blocks(hybrid_hits(t).join(texts, "id").withColumn("clause_id", F.lit(-1)))


@query(
    "vec_bm25_topk",
    f"""with {TERMS_SQL}, lens as (select id, sum(tf) as len from terms group by 1), stats as (select count(*) as n, avg(len) as mean from lens),
df as (select token, count(*) as df from terms where token in (select token from qterms) group by 1),
scored as (select qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))), 6) as score from terms join lens using (id) join df using (token) join qterms using (token), stats group by 1, 2)
select qid, id, score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from scored) where rank <= 10""",
)
def bm25(spark, sf):
    t = Tables(spark, sf)
    return vector.bm25_topk(sparse_inputs(t)[0], term_rows(t.documents, "doc_id"), TOP)


@query(
    "vec_similar_groups",
    f"""with {DENSE_SQL.format(where='where label = qlabel')}, claimed as (select label as part, id, min(qid) as owner from (select * from (select *, row_number() over (partition by label, qid order by score desc, id) as r from dense where score >= 0.3) where r <= 5) group by 1, 2)
select part, owner, list(id order by id) as members from claimed group by 1, 2 having count(*) > 1""",
)
def similar_groups(spark, sf):
    q, v = embeddings(Tables(spark, sf))
    q = q.withColumnRenamed("qlabel", "label")
    from docweave.functions.sized import small_side
    from docweave.functions.vectors import dot, norm

    pairs = v.join(small_side(q.withColumnRenamed("vec", "qvec")), "label")
    score = F.round(dot("vec", "qvec") / (norm("vec") * norm("qvec")), 6)
    scored = vector.best(pairs.select("label", "qid", "id", score.alias("score")), TOP)
    return vector.similar_groups(scored.select(F.col("label").alias("part"), F.col("qid").alias("owner"), "id", "score"), 5, 0.3)


@query(
    "metrics_at_k",
    f"""with {DENSE_SQL.format(where='where id <> qid')}, rel as (select qid, count(*) as n from q join v on label = qlabel and id <> qid group by 1),
per as (select qid, min(case when label = qlabel then rank end) as first, sum((label = qlabel)::int) as hits, sum(case when label = qlabel then 1 / log2(rank + 1) end) as dcg from dense group by 1),
ideal as (select qid, (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= n) as idcg, n from rel)
select round(avg(coalesce(1.0 / first, 0)), 9) as mrr, round(avg((hits > 0)::int), 9) as hit_rate, round(avg(coalesce(dcg, 0) / idcg), 9) as ndcg, round(avg(hits / 10.0), 9) as precision, round(avg(hits / n), 9) as recall from per join ideal using (qid)""",
)
def retrieval_metrics(spark, sf):
    q, v = embeddings(Tables(spark, sf))
    several = v.groupBy(F.col("label").alias("qlabel")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    q = q.join(several, "qlabel", "left_semi")  # the averages are over queries with a relevant item
    hits = vector.best(vector.dense_topk(q, v, TOP + 1).where("id <> qid").drop("rank"), TOP)
    return metrics.same_label(q.withColumnRenamed("qlabel", "label"), hits, v, TOP).select(*[F.round(c, 9).alias(c) for c in ("mrr", "hit_rate", "ndcg", "precision", "recall")])


PAIRS_SQL = "with p as (select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as b from conversations)"


@query(
    "generation_metrics",
    f"""{PAIRS_SQL}, s as (select conv_id, turn, (lower(trim(a, ' ')) = lower(trim(b, ' ')))::int as exact, list_distinct(list_filter(regexp_split_to_array(lower(a), '\\s+'), lambda x: x <> '')) as x, list_distinct(list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda x: x <> '')) as y from p where b is not null)
select conv_id, turn, exact, round(case when len(list_intersect(x, y)) = 0 then 0 else 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) end, 9) as f1 from s""",
)
def generation_metrics(spark, sf):
    from pyspark.sql import Window

    rows = Tables(spark, sf).conversations.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return rows.select("conv_id", "turn", metrics.exact_match(F.col("text"), F.col("next")).alias("exact"), F.round(metrics.token_f1(F.col("text"), F.col("next")), 9).alias("f1"))


@query(
    "rerank_dedup",
    """with o as (select user_id as qid, event_type as id, max_by(event_id, event_id) as payload, max_by(value, event_id) as score, min(event_id) as pos from events group by 1, 2)
select *, row_number() over (partition by qid order by score desc nulls last, pos)::int as rank from o""",
)
def rerank(spark, sf):
    e = Tables(spark, sf).events
    return fusion.rerank_dedup(e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("pos"), F.col("event_type").alias("id"), F.col("event_id").alias("payload"), F.col("value").alias("score")))


@query(
    "merge_chunks",
    """with e as (select user_id as qid, event_id as pos, event_id as chunk_id, case when event_type = 'view' then -1 else cast(floor(value) as bigint) % 7 end as clause_id, event_type from events),
c as (select qid, pos, chunk_id, clause_id, 0 as part from e where event_type = 'error'), f as (select qid, pos, chunk_id, clause_id from e where event_type <> 'error'),
o as (select * from f where clause_id <> -1 and not exists (select 1 from c where c.qid = f.qid and c.clause_id = f.clause_id)),
u as (select * from c union all select qid, pos, chunk_id, clause_id, 1 from (select *, row_number() over (partition by qid, clause_id order by pos, chunk_id) as n from o) where n = 1 union all select qid, pos, chunk_id, clause_id, 2 from f where clause_id = -1)
select *, row_number() over (partition by qid order by part, pos, chunk_id)::int as final from u""",
)
def merge(spark, sf):
    clause = F.when(F.col("event_type") == "view", -1).otherwise(F.floor("value") % 7).cast("bigint")
    e = Tables(spark, sf).events.select(F.col("user_id").alias("qid"), F.col("event_id").alias("pos"), F.col("event_id").alias("chunk_id"), clause.alias("clause_id"), "event_type")
    return fusion.merge_chunks(e.where("event_type = 'error'").drop("event_type"), e.where("event_type <> 'error'").drop("event_type"))


@query(
    "history_pairs",
    """with m as (select *, row_number() over (partition by conv_id order by turn) - 1 as n from conversations where role <> 'system')
select conv_id, n // 2 as pair, 'Q: ' || max(text) filter (n % 2 = 0) || chr(10) || 'A: ' || coalesce(max(text) filter (n % 2 = 1), '') as qa from m group by 1, 2""",
)
def history(spark, sf):
    return fusion.history_pairs(Tables(spark, sf).conversations)

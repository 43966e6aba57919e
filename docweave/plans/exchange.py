"""Queries of sources and sinks, reply parsing, tables of pages, and smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions.shared import shared_path
from docweave.operators import extraction, fusion, ontology, predicates, tree
from docweave.plans import plugins
from docweave.plans.registry import Tables, query
from docweave.sources import readers, sinks
from docweave.streaming import jobs


def place(spark, name: str) -> str:
    """A new path in the folder that the session shares with its executors."""
    return shared_path(spark, name)


@query("csv_round_trip", "select c_custkey, c_name, c_nationkey from customer")
def csv_round_trip(spark, sf):
    path = place(spark, "csv")
    sinks.as_csv(Tables(spark, sf).customer, path, ["c_custkey", "c_name", "c_nationkey"])
    return readers.delimited(spark, path, "c_custkey bigint, c_name string, c_nationkey int", sep=",")


@query("csv_without_bad_rows", "select c_custkey, c_nationkey from customer where c_nationkey % 5 <> 0")
def csv_without_bad_rows(spark, sf):
    path = place(spark, "csv")
    number = F.when(F.col("c_nationkey") % 5 == 0, F.lit("none")).otherwise(F.col("c_nationkey").cast("string"))
    Tables(spark, sf).customer.select("c_custkey", number.alias("c_nationkey")).write.csv(path, header=True, sep="\t")
    rows = readers.delimited(spark, path, "c_custkey bigint, c_nationkey int", skip_bad=True)
    return rows.where("c_custkey is not null and c_nationkey is not null")


@query("json_round_trip", "select o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') as o_orderpriority from orders")
def json_round_trip(spark, sf):
    path = place(spark, "json")
    low = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")
    sinks.as_json(Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus", low), path)
    return readers.json_lines(spark, path, "o_orderkey bigint, o_orderstatus string, o_orderpriority string")


@query("insert_delete_update", "select s_suppkey, case when s_nationkey = 3 then 'moved' else s_name end as s_name, s_nationkey from supplier where s_nationkey not in (1, 2)")
def insert_delete_update(spark, sf):
    path = place(spark, "table")
    sinks.insert(Tables(spark, sf).supplier, path, ["s_suppkey", "s_name", "s_nationkey", "no_such_field"])
    sinks.delete(spark, path, {"s_nationkey": [1, 2]})
    sinks.update(spark, path, {"s_nationkey": 3}, {"s_name": "moved"})
    return spark.read.parquet(path)


@query("upsert_table", "select c_custkey, case when c_nationkey < 10 then 'new' else c_name end as c_name from customer union all select -n_nationkey - 1, n_name from nation")
def upsert_table(spark, sf):
    path, t = place(spark, "table"), Tables(spark, sf)
    sinks.insert(t.customer, path, ["c_custkey", "c_name"])
    new = t.customer.where("c_nationkey < 10").select("c_custkey", F.lit("new").alias("c_name"))
    more = t.nation.select((-F.col("n_nationkey") - 1).cast("bigint").alias("c_custkey"), F.col("n_name").alias("c_name"))
    sinks.upsert(new.unionByName(more), path, ["c_custkey"])
    return spark.read.parquet(path)


GRAPH_SQL = """with nodes as (select c_custkey as id, c_nationkey::varchar as doc_id from customer where c_nationkey < 20),
edges as (select o_custkey as src, o_orderkey % 150 + 1 as dst, o_orderpriority as type from orders),
stored as (select src, dst, case when type in ('1-URGENT', '2-HIGH') then type else 'RELATED_TO' end as type, case when type not in ('1-URGENT', '2-HIGH') then type end as rel_type from edges where src in (select id from nodes) and dst in (select id from nodes))"""


def order_graph(t: Tables):
    """Customers as nodes, orders as edges."""
    nodes = t.customer.where("c_nationkey < 20").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("doc_id"))
    edges = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 150 + 1).alias("dst"), F.col("o_orderpriority").alias("type"))
    return nodes, sinks.stored_edges(edges, nodes, ["1-URGENT", "2-HIGH"])


@query("stored_edges", f"{GRAPH_SQL} select * from stored")
def stored_edges(spark, sf):
    return order_graph(Tables(spark, sf))[1]


@query("document_removed", f"{GRAPH_SQL}, gone as (select id from nodes where doc_id = '3') select (select count(*) from gone) as nodes, count(*) as edges from stored where src in (from gone) or dst in (from gone)")
def document_removed(spark, sf):
    return sinks.without_document(*order_graph(Tables(spark, sf)), "3")[2]


@query("subgraph_of_document", f"{GRAPH_SQL}, mine as (select id from nodes where doc_id = '3') select src, dst, coalesce(rel_type, type) as type from stored where src in (from mine) and dst in (from mine) and coalesce(rel_type, type) in ('1-URGENT', '3-MEDIUM', '5-LOW')")
def subgraph_of_document(spark, sf):
    return readers.subgraph_of(*order_graph(Tables(spark, sf)), "3", ["1-URGENT", "3-MEDIUM", "5-LOW"])[1]


@query("import_batches", "select (n // 100)::bigint as batch, count(*) filter (c_acctbal >= 0) as ok, count(*) filter (c_acctbal < 0) as failed from (select *, row_number() over (order by c_custkey) - 1 as n from customer) where n // 100 >= 1 group by 1")
def import_batches(spark, sf):
    reason = F.when(F.col("c_acctbal") < 0, "negative balance")
    return sinks.import_rows(Tables(spark, sf).customer, "c_custkey", reason, place(spark, "good"), place(spark, "bad"), start=1)


@query("filter_keywords", "select * from customer where c_nationkey = 0 and c_mktsegment = 'AUTOMOBILE'")
def filter_keywords(spark, sf):
    return predicates.select_all(Tables(spark, sf).customer, c_nationkey=0, c_mktsegment="AUTOMOBILE")


@query("row_by_id", "select * from customer where c_custkey = 7")
def row_by_id(spark, sf):
    return predicates.by_id(Tables(spark, sf).customer, "c_custkey", 7)


@query("filter_vocabulary", "select p_partkey, p_type from part where p_brand = 'Brand#12' and nullif(p_size % 3, 0) is null")
def filter_vocabulary(spark, sf):
    """Concepts of one vocabulary that nothing makes invalid (FLT9)."""
    concepts = Tables(spark, sf).part.withColumn("invalid_reason", F.nullif(F.col("p_size") % 3, F.lit(0)))
    return concepts.where(predicates.matching({"p_brand": "Brand#12"}) & F.col("invalid_reason").isNull()).select("p_partkey", "p_type")


@query("allowed_uploads", "select c_custkey from customer where c_name <> '' and c_custkey % 4 in (0, 1)")
def allowed_uploads(spark, sf):
    """Uploads with a name and a content type that is allowed (FLT14)."""
    kinds = F.element_at(F.array(*map(F.lit, ("application/pdf", "text/plain", "image/png", ""))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = Tables(spark, sf).customer.withColumn("content_type", kinds)
    return rows.where((F.col("c_name") != "") & predicates.matching({"content_type": ["application/pdf", "text/plain"]})).select("c_custkey")


@query("arrays_without_nulls", "select c_custkey, list_filter([nullif(c_nationkey, 3), c_nationkey + 1, nullif(c_nationkey, 4)], lambda x: x is not null) as keys from customer")
def arrays_without_nulls(spark, sf):
    keys = F.array(F.nullif("c_nationkey", F.lit(3)), F.col("c_nationkey") + 1, F.nullif("c_nationkey", F.lit(4)))
    return Tables(spark, sf).customer.select("c_custkey", predicates.without_nulls(keys).alias("keys"))


@query("vocabulary_stats", "select p_brand, count(*) as total, count(*) filter (p_size > 10) as named, count(*) filter (p_type like 'S%') as standard, count(*) filter (p_size % 3 = 0) as valid from part group by 1")
def vocabulary_stats(spark, sf):
    """Concepts of each vocabulary by kind (AGG14)."""
    some = lambda c, name: F.count_if(c).alias(name)
    return Tables(spark, sf).part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("total"), some(F.col("p_size") > 10, "named"), some(F.startswith("p_type", F.lit("S")), "standard"), some(F.col("p_size") % 3 == 0, "valid"))


@query("entities_per_document", f"{GRAPH_SQL} select doc_id, count(*) as entities, row_number() over (order by count(*) desc, doc_id)::int as place from nodes group by 1")
def entities_per_document(spark, sf):
    """Entities of each document, most first (AGG15): as many rows as documents, counted before they are ranked."""
    from docweave.operators.windows import numbered

    counts = order_graph(Tables(spark, sf))[0].groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities"))
    return counts.withColumn("place", numbered([], F.desc("entities"), "doc_id"))


@query("document_counters", "select conv_id, sum(length(text) // 4)::bigint as token_num, count(*) as chunk_num from conversations group by 1")
def document_counters(spark, sf):
    """Tokens and chunks that a document has accumulated (AGG21)."""
    return Tables(spark, sf).conversations.groupBy("conv_id").agg(F.sum(tx.tokens_estimate(F.col("text"))).alias("token_num"), F.count(F.lit(1)).alias("chunk_num"))


@query("distinct_first", "select o_custkey, o_orderstatus, min(o_orderkey) as o_orderkey from orders group by 1, 2")
def distinct_first(spark, sf):
    """The first row of each composite key (SET5)."""
    rows = Tables(spark, sf).orders.groupBy("o_custkey", "o_orderstatus")
    return rows.agg(F.min_by("o_orderkey", "o_orderkey").alias("o_orderkey"))


@query("path_strings", "select n_name || ' -> ' || r_name as path from nation join region on n_regionkey = r_regionkey order by n_nationkey limit 25")
def path_strings(spark, sf):
    """The first 25 paths as text (TOP5)."""
    t = Tables(spark, sf)
    paths = t.nation.join(F.broadcast(t.region.limit(1000)), F.col("n_regionkey") == F.col("r_regionkey"))
    return paths.orderBy("n_nationkey").limit(25).select(F.concat_ws(" -> ", "n_name", "r_name").alias("path"))


@query("reply_lines", "select c_custkey, [c_name, '- ' || c_mktsegment] as lines from customer")
def reply_lines(spark, sf):
    reply = F.concat(F.lit('<think>a\nb</think>输出: "'), "c_name", F.lit('"\n\n- '), "c_mktsegment", F.lit("\n```"))
    return Tables(spark, sf).customer.select("c_custkey", tx.reply_lines(reply).alias("lines"))


@query("json_in_reply", "select c_custkey, '{\"id\": ' || c_custkey || ', \"segment\": \"' || c_mktsegment || ' {x}\"}' as json from customer")
def json_in_reply(spark, sf):
    reply = F.concat(F.lit('Sure: ```json\n{"id": '), "c_custkey", F.lit(' /* key */, "segment": "'), "c_mktsegment", F.lit(' {x}"}``` done {'))
    return Tables(spark, sf).customer.select("c_custkey", tx.json_of(reply).alias("json"))


@query("ids_in_reply", "select c_custkey, [c_custkey, c_nationkey::bigint] as ids from customer")
def ids_in_reply(spark, sf):
    reply = F.concat(F.lit("broken {relevant_clause_ids: ["), "c_custkey", F.lit(", "), "c_nationkey", F.lit("] and 99"))
    return Tables(spark, sf).customer.select("c_custkey", tx.id_list(reply).alias("ids"))


@query("filled_template", "select c_custkey, 'Name: ' || c_name || '; again ' || c_name || ' in ' || c_nationkey as prompt from customer")
def filled_template(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", tx.filled("Name: {{ name }}; again {{name}} in {{ nation }}", name=F.col("c_name"), nation=F.col("c_nationkey")).alias("prompt"))


@query("repaired_json", "select c_custkey, '{\"' || c_custkey || '\":1, \"2\":{\"3\": 4}}' as json from customer")
def repaired_json(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", tx.repaired_json(F.concat(F.lit("{"), "c_custkey", F.lit(":1, 2 :{3: 4}}"))).alias("json"))


def asked(spark, sf):
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("find "), "c_name"))
    intent = F.when(F.col("c_custkey") % 2 == 0, "logic").otherwise("other")
    reply = F.concat(F.lit('{"query": "'), name, F.lit('", "intent": "'), intent, F.lit('"}'))
    return Tables(spark, sf).customer.select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("query"), reply.alias("reply"), "c_name")


@query("rewrite_unified", "select c_custkey as qid, 0 as n, case when c_custkey % 3 = 0 then c_mktsegment else 'find ' || c_name end as query, case when c_custkey % 2 = 0 then 'logic' else 'fact' end as intent from customer")
def rewrite_unified(spark, sf):
    return plugins.rewritten(asked(spark, sf), "unified", F.col("reply"))


@query("rewrite_hyde", "select c_custkey as qid, 0 as n, case when c_custkey % 3 = 0 then c_mktsegment else c_name end as query, 'fact' as intent from customer")
def rewrite_hyde(spark, sf):
    return plugins.rewritten(asked(spark, sf), "hyde", F.when(F.col("qid") % 3 != 0, F.concat(F.lit("  "), "c_name")))


@query("rewrite_multi", "select c_custkey as qid, n, [c_mktsegment, c_name, 'more'][n + 1] as query, 'fact' as intent from customer, (select unnest([0, 1, 2]) as n)")
def rewrite_multi(spark, sf):
    return plugins.rewritten(asked(spark, sf), "multi", F.concat(F.col("c_name"), F.lit("\n\n  more ")))


@query("rewrite_failed", "select c_custkey as qid, 0 as n, c_mktsegment as query, 'fact' as intent from customer")
def rewrite_failed(spark, sf):
    """A model that does not answer, or not in JSON, leaves the query as it is (QRW4)."""
    return plugins.rewritten(asked(spark, sf), "unified", F.when(F.col("qid") % 2 == 0, F.lit("no json")))


def listed(spark, sf):
    """A page for each customer: a list table and one of names and values."""
    html = F.concat(F.lit("<p>x</p><table><tr><th>Name</th><th>Segment</th></tr><tr><td>"), "c_name", F.lit("</td><td>"), "c_mktsegment", F.lit("</td></tr></table><table><tr><td>Total</td><td>Nation</td><td>"), "c_nationkey", F.lit("</td><td>Key</td><td>"), "c_custkey", F.lit("</td></tr></table>"))
    return extraction.table_cells(Tables(spark, sf).customer.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), html.alias("text")))


@query("table_kinds", "select c_custkey as doc_id, 1 as page, 0 as tbl, 'people' as field from customer")
def table_kinds(spark, sf):
    return extraction.table_kinds(listed(spark, sf), {"people": ["Name", "Person"], "goods": ["Part"]})


@query("table_rows", "select c_custkey as doc_id, 'people' as field, 0 as row, unnest(['Name', 'Segment']) as name, unnest([c_name, c_mktsegment]) as value from customer")
def table_rows(spark, sf):
    cells = listed(spark, sf)
    return extraction.list_rows(cells, extraction.table_kinds(cells, {"people": ["Name"]}))


@query("table_key_values", "select c_custkey as doc_id, 1 as page, 1 as tbl, 0 as row, unnest(['Nation', 'Key']) as name, unnest([c_nationkey::varchar, c_custkey::varchar]) as value from customer")
def table_key_values(spark, sf):
    return extraction.key_values(listed(spark, sf).where("tbl = 1"), ["Total"])


@query("heading_chunks", "select n_nationkey as doc_id, unnest([0, 1, 2]) as pos, n_nationkey || '_' || unnest([0, 1, 2]) as chunk_id, unnest(['before', '# ' || n_name || chr(10) || 'text', '## Part' || chr(10) || 'end']) as text, unnest([[1], [], [2]]) as markers from nation")
def heading_chunks(spark, sf):
    n = Tables(spark, sf).nation
    one = n.select(F.col("n_nationkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("before\n# "), "n_name", F.lit("\ntext\n## Part")).alias("text"))
    return extraction.heading_chunks(one.unionByName(n.select(F.col("n_nationkey").alias("doc_id"), F.lit(2).alias("page"), F.lit("end").alias("text"))))


def clauses(spark, sf):
    """A forest of three nodes for each nation, and a level-1 title without children."""
    lines = F.array(*[F.struct(F.lit(page).alias("page"), x.alias("text")) for page, x in ((1, F.lit("preface")), (1, F.concat(F.lit("保险条款（"), "n_name", F.lit("）"))), (1, F.lit("第一部分 总则")), (2, F.concat(F.lit("body of "), "n_name")), (2, F.lit("第一条 定义")), (3, F.lit("last words")), (3, F.lit("保险条款（空）")))])
    rows = Tables(spark, sf).nation.select(F.col("n_nationkey").alias("doc_id"), F.posexplode(lines).alias("pos", "x")).select("doc_id", "pos", "x.page", "x.text")
    return tree.forest(tree.classified(rows))


@query("forest_nodes", "select n_nationkey as doc_id, unnest([1, 2, 3])::bigint as node_id, unnest([0, 1, 2])::bigint as parent_id, unnest([1, 2, 3]) as level, unnest(['', 'body of ' || n_name, 'last words']) as content, unnest([[1], [1, 2], [2, 3]]) as pages from nation")
def forest_nodes(spark, sf):
    return clauses(spark, sf).select("doc_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("parent_id").cast("bigint").alias("parent_id"), "level", "content", "pages")


@query("chunks_of_nodes", "select n_nationkey as doc_id, unnest([0, 1]) as chunk_id, unnest([2, -1])::bigint as node_id, unnest(['1.2', 'N/A']) as clause_path from nation")
def chunks_of_nodes(spark, sf):
    chunk = F.posexplode(F.array(F.concat(F.lit("body of "), "n_name"), F.lit("nowhere to be found")))
    rows = Tables(spark, sf).nation.select(F.col("n_nationkey").alias("doc_id"), F.lit(2).alias("page"), chunk.alias("chunk_id", "text"))
    return tree.matched(rows, clauses(spark, sf)).select("doc_id", "chunk_id", F.col("node_id").cast("bigint").alias("node_id"), "clause_path")


@query("chunk_ids_below", "select n_nationkey as doc_id, 2::bigint as node_id, unnest([20, 30])::bigint as chunk_id from nation")
def chunk_ids_below(spark, sf):
    nodes = clauses(spark, sf).withColumn("node_id", F.col("node_id").cast("bigint"))
    nodes = nodes.withColumns({"path": F.col("path").cast("array<bigint>"), "chunk_ids": F.array(F.col("node_id") * 10)})
    return tree.chunk_ids(nodes, nodes.where("node_id = 2").select("doc_id", "node_id"), children=True)


@query("neighbour_text", "select conv_id, turn, concat_ws(chr(10), lag(text) over w, text, lead(text) over w) as text from conversations where text is not null window w as (partition by conv_id order by turn)")
def neighbour_text(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    key = F.concat_ws(":", "conv_id", "turn")
    rows = Tables(spark, sf).conversations.where("text is not null").withColumn("chunk_id", key)
    rows = rows.withColumns({"prev_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w)})
    return fusion.neighbour_text(rows).select("conv_id", "turn", "text")


@query("streamed_answers", "select user_id, event_type as kind, string_agg(event_id::varchar, '' order by event_id) as text from events group by 1, 2")
def streamed_answers(spark, sf):
    parts = Tables(spark, sf).events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("text"))
    return jobs.answers(parts, "user_id")


@query("graph_jobs", "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey > 0")
def graph_jobs(spark, sf):
    rows = Tables(spark, sf).customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "policy").otherwise("claim").alias("doc_type"), F.col("c_nationkey").alias("clause_count"))
    return jobs.graph_jobs(rows).select("c_custkey")


@query("confirmed_ids", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 5)")
def confirmed_ids(spark, sf):
    t = Tables(spark, sf)
    candidates = t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return ontology.confirmed(t.orders.select("o_orderkey", "o_custkey"), candidates, "o_custkey").select("o_orderkey", "o_custkey")


@query("claim_status", "select o_orderkey, case o_orderstatus when 'F' then 'approved' when 'O' then 'rejected' else 'under_review' end as status from orders")
def claim_status(spark, sf):
    decision = F.when(F.col("o_orderstatus") == "F", "approve").when(F.col("o_orderstatus") == "O", "reject")
    return Tables(spark, sf).orders.select("o_orderkey", ontology.claim_status(decision).alias("status"))


@query("glossary_notes", "select c_custkey as id, c_mktsegment || coalesce(' (' || case c_mktsegment when 'BUILDING' then 'BUILDING: houses' when 'MACHINERY' then 'MACHINERY: engines' end || ')', '') as text from customer")
def glossary_notes(spark, sf):
    terms = spark.createDataFrame([("BUILDING", "houses"), ("MACHINERY", "engines")], "term string, meaning string")
    return ontology.glossary(Tables(spark, sf).customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text")), terms)

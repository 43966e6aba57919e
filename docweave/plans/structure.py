"""Queries over trees, extracted fields, graphs, vocabularies and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import extraction, graph, ontology, tree, windows
from docweave.operators import predicates
from docweave.plans.registry import Tables, query

# A tree of four levels: regions, their nations, their customers, their orders. Node ids follow
# the sorted keys of all levels, so they are in pre-order.
KEYS_SQL = """k as (select r_regionkey::bigint as a, -1::bigint as b, -1::bigint as c, -1::bigint as d, 1 as level, r_name as title from region
union all select n_regionkey, n_nationkey, -1, -1, 2, n_name from nation
union all select n_regionkey, c_nationkey, c_custkey, -1, 3, c_name from customer join nation on c_nationkey = n_nationkey
union all select n_regionkey, c_nationkey, o_custkey, o_orderkey, 4, 'order ' || o_orderkey from orders join customer on c_custkey = o_custkey join nation on c_nationkey = n_nationkey),
n as (select *, row_number() over (order by a, b, c, d) as node_id from k),
p as (select x.*, coalesce(case x.level when 2 then (select node_id from n where n.a = x.a and n.level = 1) end, y.node_id, 0) as parent_id from n x left join n y on (x.level = 3 and y.level = 2 and y.a = x.a and y.b = x.b) or (x.level = 4 and y.level = 3 and y.a = x.a and y.b = x.b and y.c = x.c))"""


def numbered_nodes(t: Tables):
    """Lines of the four-level tree in document order: one document for each region."""
    none = F.lit(-1).cast("bigint")
    r = t.region.select(F.col("r_regionkey").cast("bigint").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"), F.lit(1).alias("level"), F.col("r_name").alias("title"))
    n = t.nation.select(F.col("n_regionkey").cast("bigint").alias("a"), F.col("n_nationkey").cast("bigint").alias("b"), none.alias("c"), none.alias("d"), F.lit(2).alias("level"), F.col("n_name").alias("title"))
    place = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("bigint").alias("a")))  # one row for each nation
    c = t.customer.join(place, "c_nationkey")
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    c = c.select("a", F.col("c_nationkey").cast("bigint").alias("b"), F.col("c_custkey").alias("c"), none.alias("d"), F.lit(3).alias("level"), F.col("c_name").alias("title"))
    o = o.select("a", F.col("c_nationkey").cast("bigint").alias("b"), F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("d"), F.lit(4).alias("level"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"))
    rows = r.unionByName(n).unionByName(c).unionByName(o)
    return rows.withColumn("node_id", F.row_number().over(Window.partitionBy("a").orderBy("b", "c", "d")).cast("bigint"))


LOCAL_SQL = KEYS_SQL.replace("over (order by a, b, c, d)", "over (partition by a order by b, c, d)").replace("y.level = 2 and y.a", "y.level = 2 and y.a").replace("(select node_id from n where n.a = x.a and n.level = 1)", "1")


@query("tree_parents", f"with {LOCAL_SQL} select a as doc_id, node_id, level, title, parent_id from p")
def tree_parents(spark, sf):
    out = windows.parents(numbered_nodes(Tables(spark, sf)), ["a"], "node_id", "level")
    return out.select(F.col("a").alias("doc_id"), "node_id", "level", "title", F.col("parent").alias("parent_id"))


def nodes_of(t: Tables):
    out = windows.parents(numbered_nodes(t), ["a"], "node_id", "level").withColumnRenamed("a", "doc_id").withColumnRenamed("parent", "parent_id")
    return tree.with_paths(out.select("doc_id", "node_id", "parent_id", "level", "title"))


PATH_SQL = f"""with {LOCAL_SQL}, q as (select x.a as doc_id, x.node_id, x.level, x.title, x.parent_id, list_filter([u3.node_id, u2.node_id, u1.node_id, x.node_id], lambda v: v is not null) as path from p x
left join p u1 on u1.a = x.a and u1.node_id = x.parent_id left join p u2 on u2.a = x.a and u2.node_id = u1.parent_id left join p u3 on u3.a = x.a and u3.node_id = u2.parent_id)"""


@query("tree_paths", f"{PATH_SQL} select doc_id, node_id, array_to_string(path, '.') as clause_path from q")
def tree_paths(spark, sf):
    return nodes_of(Tables(spark, sf)).select("doc_id", "node_id", tree.clause_path(F.col("path")).alias("clause_path"))


@query("tree_subtree", f"{PATH_SQL} select doc_id, node_id from q where list_contains(path, 2)")
def subtree(spark, sf):
    return tree.subtree(nodes_of(Tables(spark, sf)), 2).select("doc_id", "node_id")


@query("tree_outline", f"{PATH_SQL} select doc_id, string_agg(repeat('#', level + 2) || ' ' || title || ' [ID:' || node_id || '] <0 chunks>', chr(10) order by node_id) as outline from q where level <= 2 group by 1")
def outline(spark, sf):
    nodes = nodes_of(Tables(spark, sf)).where("level <= 2").withColumn("n_chunks", F.lit(0))
    return tree.outline(nodes, ["doc_id"])


@query("ancestor_closure", f"{PATH_SQL} select distinct doc_id as qid, unnest(path) as node_id from q where level = 4")
def closure(spark, sf):
    from docweave.operators.fusion import ancestor_closure

    nodes = nodes_of(Tables(spark, sf)).withColumnRenamed("doc_id", "qid")
    return ancestor_closure(nodes.where("level = 4").select("qid", "node_id"), nodes)


@query("tree_ranges", "select user_id, event_id as start, greatest(event_id, coalesce(lead(event_id) over (partition by user_id order by event_id) - 1, 1000000))::bigint as end from events where event_type = 'signup'")
def ranges(spark, sf):
    e = Tables(spark, sf).events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start"), F.lit(1000000).cast("bigint").alias("last"))
    return windows.ranges(e, ["user_id"], "start", "last").drop("last")


@query("heading_classify", "select page_id, i - 1 as pos, case when l like '第%' then 2 when l like '（%' then 4 end::int as level from (select page_id, generate_subscripts(p, 1) as i, unnest(p) as l from (select page_id, ['第一部分 ' || page_id, '（一） ' || url, 'plain'] as p from pages))")
def classify(spark, sf):
    lines = Tables(spark, sf).pages.select("page_id", F.posexplode(F.array(F.concat(F.lit("第一部分 "), "page_id"), F.concat(F.lit("（一） "), "url"), F.lit("plain"))).alias("pos", "text"))
    return tree.classified(lines).select("page_id", F.col("pos").cast("bigint").alias("pos"), "level")


@query("html_fields", "select page_id as doc_id, unnest(['title', 'lang']) as field, unnest([regexp_extract(html, '<title>([^<]*)</title>', 1), regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)]) as value from pages where regexp_matches(html, '<title>[^<]*</title>') and regexp_matches(html, '<html lang=\"[a-z]+\"')")
def html_fields(spark, sf):
    pages = Tables(spark, sf).pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.col("html").alias("text"))
    found = extraction.regex_fields(pages, {"title": ("<title>([^<]*)</title>", 1), "lang": ('<html lang="([a-z]+)"', 1)})
    both = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("doc_id")
    return found.join(both, "doc_id", "left_semi").select("doc_id", "field", "value")


@query("convert_types", "select o_orderkey, cast(o_orderdate as date) as day, round(o_totalprice, 2)::decimal(15, 2) as price, null::date as bad from orders")
def convert(spark, sf):
    d = F.concat(F.year("o_orderdate"), F.lit("年"), F.date_format("o_orderdate", "MM"), F.lit("月"), F.date_format("o_orderdate", "dd"), F.lit("日"))
    price = F.format_number(F.round("o_totalprice", 2), 2)
    return Tables(spark, sf).orders.select("o_orderkey", tx.converted(d, "date").alias("day"), tx.converted(price, "decimal").alias("price"), tx.converted(F.lit("x"), "date").alias("bad"))


@query("field_validity", "select c_custkey, regexp_matches(c_name, '^[0-9A-Z]{10,18}$') as id_ok, regexp_matches('1' || (3000000000 + c_custkey), '^1[3-9][0-9]{9}$') as phone_ok from customer")
def validity(spark, sf):
    phone = F.concat(F.lit("1"), (F.lit(3000000000) + F.col("c_custkey")).cast("string"))
    return Tables(spark, sf).customer.select("c_custkey", extraction.valid(F.col("c_name"), "id_number").alias("id_ok"), extraction.valid(phone, "phone").alias("phone_ok"))


@query(
    "confidence",
    """with f as (select c_custkey as doc_id, unnest(['a', 'b']) as field, unnest([0.95, case when c_nationkey % 5 >= 3 then 0.9 when c_nationkey % 5 >= 1 then 0.8 else 0.6 end]) * 0.3 + 0.3 + 0.4 * (c_acctbal > 0)::int as confidence from customer)
select doc_id, round(avg(confidence) * 0.7 + 2 / 4.0 * 0.3, 9) as overall from f group by 1""",
)
def confidence(spark, sf):
    c = Tables(spark, sf).customer
    rows = c.select(F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") % 5).alias("kv"), (F.col("c_acctbal") > 0).cast("int").alias("q"), F.explode(F.create_map(F.lit("a"), F.lit("content_regex"), F.lit("b"), F.lit("grid_fallback"))).alias("field", "source"))
    one = extraction.field_confidence(extraction.source_confidence(F.col("source"), F.lit(True), F.col("kv")), F.lit(1.0), F.col("q"))
    return extraction.overall_confidence(rows.select("doc_id", "field", one.alias("confidence")), 4).withColumn("overall", F.round("overall", 9))


@query("versioned_replace", "select c_custkey, c_name, case when c_acctbal < 0 then 'I' else 'A' end as status from customer union all select c_custkey, 'new', 'A' from customer where c_acctbal < 0")
def versioned(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_name", F.lit("A").alias("status"), "c_acctbal")
    return extraction.replaced(c, c.where("c_acctbal < 0").withColumn("c_name", F.lit("new")), "c_custkey").drop("c_acctbal")


LONG_SQL = "a as (select user_id as doc_id, event_type as field, 0 as row, 'v' as name, case when count(*) % 3 = 0 then '' else count(*)::varchar end as value from events where event_type <> 'view' group by 1, 2), b as (select user_id as doc_id, event_type as field, 0 as row, 'v' as name, 'second' as value from events where event_type <> 'click' group by 1, 2)"


def long_tables(t: Tables):
    e = t.events
    n = F.count(F.lit(1))
    a = e.where("event_type <> 'view'").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field")).agg(F.lit(0).alias("row"), F.lit("v").alias("name"), F.when(n % 3 == 0, "").otherwise(n.cast("string")).alias("value"))
    b = e.where("event_type <> 'click'").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field")).agg(F.lit(0).alias("row"), F.lit("v").alias("name"), F.lit("second").alias("value"))
    return a, b


@query("fill_only_merge", f"with {LONG_SQL} select doc_id, field, row, name, coalesce(nullif(a.value, ''), b.value) as value from a full join b using (doc_id, field, row, name)")
def fill(spark, sf):
    return extraction.fill_only(*long_tables(Tables(spark, sf)))


@query("missing_extractions", f"with {LONG_SQL} select u.doc_id, f.field, 'v' as name from (select distinct user_id as doc_id from events) u, (select unnest(['click', 'view']) as field) f where not exists (select 1 from a where a.doc_id = u.doc_id and a.field = f.field and a.value <> '')")
def missing(spark, sf):
    t = Tables(spark, sf)
    expected = spark.sql("select * from values ('click', 'v'), ('view', 'v') as t(field, name)")
    return extraction.missing(long_tables(t)[0], t.events.select(F.col("user_id").alias("doc_id")), expected)


@query("flatten_fields", f"with {LONG_SQL} select doc_id, max(value) filter (field = 'click') as clicks, max(value) filter (field = 'error') as errors from a group by 1")
def flatten(spark, sf):
    return extraction.flattened(long_tables(Tables(spark, sf))[0], {"clicks": ("click", "v"), "errors": ("error", "v")})


RECORD_SQL = """r as (select o_custkey % 10 as root_id, o_orderkey as pos, 'CUSTOMER ' || (o_custkey % 50) as src, 'ORDER ' || (o_orderkey % 40) as dst, o_orderpriority as kind, o_orderstatus as st from orders)"""


def replies(t: Tables):
    o = t.orders.select((F.col("o_custkey") % 10).alias("root_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Customer "), F.col("o_custkey") % 50).alias("src"), F.concat(F.lit("Order "), F.col("o_orderkey") % 40).alias("dst"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("st"))
    text = F.format_string('("entity"<|>"%s"<|>"%s"<|>"has %s"<|>"%d")##("relationship"<|>"%s"<|>"%s"<|>"%s"<|>"made %s")<|COMPLETE|>', "src", "kind", "st", "root_id", "src", "dst", "kind", "st")
    return o.select(F.lit("d").alias("doc_id"), "root_id", "pos", text.alias("text"))


def parsed(t: Tables):
    """Records of all replies; a reply's key keeps them in order."""
    r = replies(t)
    found = graph.records(r.withColumn("root_id", F.struct("root_id", F.col("pos").alias("at"))))
    return found.select("doc_id", F.col("root_id.root_id").alias("root_id"), F.col("root_id.at").alias("pos"), "parts")


@query("graph_entities", f"with {RECORD_SQL} select root_id, pos, src as name, upper(kind) as type, 'has ' || st as description from r")
def entities(spark, sf):
    return graph.entities(parsed(Tables(spark, sf))).select("root_id", "pos", "name", "type", "description")


NODE_SQL = "k as (select root_id, src, kind, count(*) as n, min(pos) as f from r group by 1, 2, 3), m as (select root_id, src, kind from (select *, row_number() over (partition by root_id, src order by n desc, f) as i from k) where i = 1)"


@query(
    "graph_nodes",
    f"with {RECORD_SQL}, {NODE_SQL} select root_id, src as name, upper(any_value(m.kind)) as type, string_agg(distinct 'has ' || st, '<SEP>' order by 'has ' || st) as description, ('0x' || substr(sha256('d:' || root_id || ':' || src), 1, 15))::bigint as id from r join m using (root_id, src) group by 1, 2",
)
def graph_nodes(spark, sf):
    return graph.merged_nodes(graph.entities(parsed(Tables(spark, sf)))).select("root_id", "name", "type", "description", "id")


@query(
    "graph_edges",
    f"""with {RECORD_SQL}, k as (select root_id, src, dst, kind, count(*) as n, min(pos) as f from r group by 1, 2, 3, 4), m as (select root_id, src, dst, kind from (select *, row_number() over (partition by root_id, src, dst order by n desc, f) as i from k) where i = 1)
select root_id, src, dst, upper(any_value(m.kind)) as type, string_agg(distinct 'made ' || st, '<SEP>' order by 'made ' || st) as description, ('0x' || substr(sha256('d:' || root_id || ':' || src || ':' || dst || ':' || upper(any_value(m.kind))), 1, 15))::bigint as id from r join m using (root_id, src, dst) group by 1, 2, 3""",
)
def graph_edges(spark, sf):
    return graph.merged_edges(graph.relationships(parsed(Tables(spark, sf)))).select("root_id", "src", "dst", "type", "description", "id")


# A sparse graph over nations: two edges out of each, one kind for even keys.
EDGES_SQL = "e as (select n_nationkey::bigint as src, (n_nationkey * 7 + 3)::bigint % 25 as dst, case when n_nationkey % 4 = 0 then 'NOT_INCLUDE' else 'INCLUDE' end as type from nation union select n_nationkey, (n_nationkey * n_nationkey + 1) % 25, 'RELATED_TO' from nation)"


def nation_edges(t: Tables):
    n = t.nation.select(F.col("n_nationkey").cast("bigint").alias("src"))
    one = n.select("src", ((F.col("src") * 7 + 3) % 25).alias("dst"), F.when(F.col("src") % 4 == 0, "NOT_INCLUDE").otherwise("INCLUDE").alias("type"))
    return one.unionByName(n.select("src", ((F.col("src") * F.col("src") + 1) % 25).alias("dst"), F.lit("RELATED_TO").alias("type"))).distinct()


PATHS_SQL = f"""with recursive {EDGES_SQL}, w as (select src, dst, [src, dst] as nodes, [type] as rels from e where src = 2 and src <> dst union all select w.src, e.dst, list_append(nodes, e.dst), list_append(rels, e.type) from w join e on w.dst = e.src where len(rels) < 5 and not list_contains(nodes, e.dst))"""


@query("paths_bounded", f"{PATHS_SQL} select src, dst, array_to_string(nodes, '>') as nodes, len(rels)::int as length, case when list_contains(rels, 'NOT_INCLUDE') then 'exclusion' else 'coverage' end as class from w")
def paths(spark, sf):
    found = graph.evidence(graph.paths(nation_edges(Tables(spark, sf)), spark.sql("select 2L as id")))
    return found.select("src", "dst", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"), "length", "class")


@query("path_text", f"{PATHS_SQL} select case len(rels) when 1 then nodes[1] || ' --' || rels[1] || '--> ' || nodes[2] else nodes[1] || ' --' || rels[1] || '--> ' || nodes[2] || ' --' || rels[2] || '--> ' || nodes[3] end as path from w where len(rels) <= 2")
def path_text(spark, sf):
    from docweave.operators.fusion import path_text as shown

    found = graph.paths(nation_edges(Tables(spark, sf)), spark.sql("select 2L as id"), hops=2)
    return found.select(shown(F.transform("nodes", lambda x: x.cast("string")), F.col("rels")).alias("path"))


@query("k_hop", f"with recursive {EDGES_SQL}, u as (select src, dst from e union select dst, src from e), h as (select 0::bigint as id, 0 as hop union all select u.dst, hop + 1 from h join u on u.src = h.id where hop < 2) select id, min(hop)::int as hop from h group by 1")
def k_hop(spark, sf):
    return graph.neighbourhood(nation_edges(Tables(spark, sf)), spark.sql("select 0L as id"))


ROUNDS = 20
RANK_SQL = "with " + EDGES_SQL + ", l as (select distinct src, dst from e), o as (select src, count(*) as out from l group by 1), r0 as (select n_nationkey::bigint as id, 1 / 25::double as rank from nation)" + "".join(
    f", r{i + 1} as (select r.id, 0.15 / 25 + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from r{i} where id not in (select src from o)) / 25) as rank from r{i} r left join (select l.dst as id, sum(rank / out) as got from l join r{i} x on x.id = l.src join o on o.src = l.src group by 1) g using (id))" for i in range(ROUNDS)
)


@query("pagerank", RANK_SQL + f" select id, round(rank, 9) as rank from r{ROUNDS}")
def pagerank(spark, sf):
    t = Tables(spark, sf)
    nodes = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"))
    return graph.pagerank(nodes, nation_edges(t), rounds=ROUNDS, tolerance=0.0).select("id", F.round("rank", 9).alias("rank"))


@query("align_repoint", f"with {EDGES_SQL}, m as (select src as old, src - src % 3 as new from (select distinct src from e)), x as (select distinct a.new as src, b.new as dst, type from e join m a on a.old = e.src join m b on b.old = e.dst where a.new <> b.new) select src, dst, type, ('0x' || substr(sha256('d:0:' || src || ':' || dst || ':' || type), 1, 15))::bigint as id from x")
def align(spark, sf):
    t = Tables(spark, sf)
    names = t.nation.select(F.col("n_nationkey").cast("bigint").alias("name"))
    edges = nation_edges(t).select(F.lit("d").alias("doc_id"), F.lit(0).alias("root_id"), "src", "dst", "type")
    return graph.realigned(edges, names.select(F.col("name").alias("old"), (F.col("name") - F.col("name") % 3).alias("new")), names).select("src", "dst", "type", "id")


@query("subgraph_last_edge", f"with {EDGES_SQL} select src, dst, max(type) as type from e where src in (select n_nationkey from nation where n_regionkey < 3) and dst in (select n_nationkey from nation where n_regionkey < 3) group by 1, 2")
def subgraph(spark, sf):
    t = Tables(spark, sf)
    nodes = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return graph.subgraph(nodes, nation_edges(t), order="type").select("src", "dst", "type")


@query("edge_context", f"with {EDGES_SQL}, c as (select src as id, 'out' as way, type, dst as other from e union select dst, 'in', type, src from e) select id, string_agg(way || ' ' || type || ' ' || other, ', ' order by way, type, other) as context from c group by 1")
def edge_context(spark, sf):
    t = Tables(spark, sf)
    out = graph.edge_context(nation_edges(t), t.nation.select(F.col("n_nationkey").cast("bigint").alias("id")))
    return out.select("id", F.array_join(F.transform("context", lambda x: F.concat_ws(" ", x["way"], x["type"], x["other"])), ", ").alias("context"))


@query("graph_merge", f"with {EDGES_SQL}, d as (select id, count(*) as degree from (select src as id from (select distinct src, dst from e) union all select dst from (select distinct src, dst from e)) group by 1) select n_nationkey::bigint as id, case when n_nationkey < 20 and n_nationkey >= 10 then n_name || '<SEP>' || n_name else n_name end as description, coalesce(degree, 0) as rank from nation left join d on id = n_nationkey")
def graph_merge(spark, sf):
    t = Tables(spark, sf)
    n = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.lit("NATION").alias("type"), F.col("n_name").alias("description"), F.array(F.col("n_regionkey").cast("string")).alias("clause_ids"))
    e = nation_edges(t).groupBy("src", "dst").agg(F.max("type").alias("type")).withColumn("description", F.lit("x"))
    nodes, _ = graph.merged_graph((n.where("id < 20"), e.where("src < 12")), (n.where("id >= 10"), e.where("src >= 8")))
    return nodes.select("id", "description", "rank")


@query("ontology_direct", "select distinct l_partkey as source, l_suppkey as target, 1 as path_length from lineitem where l_partkey in (select p_partkey from part where p_size <= 10) and l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)")
def onto_direct(spark, sf):
    t = Tables(spark, sf)
    maps = t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return ontology.direct(maps, t.part.where("p_size <= 10").select(F.col("p_partkey").alias("source")), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("target"))).drop("rels")


@query("ontology_by_hops", f"with recursive {EDGES_SQL}, u as (select src, dst from e union select dst, src from e), h as (select n_regionkey::bigint as source, n_nationkey::bigint as node, 0 as hop from nation where n_nationkey < 10 union select source, u.dst, hop + 1 from h join u on u.src = h.node where hop < 2), b as (select source, node, min(hop) as hop from h group by 1, 2) select source, node as target, (hop + 1)::int as path_length from b where hop > 0 and node >= 15")
def onto_hops(spark, sf):
    t = Tables(spark, sf)
    maps = t.nation.where("n_nationkey < 10").select(F.col("n_regionkey").cast("bigint").alias("source"), F.col("n_nationkey").cast("bigint").alias("target"))
    isa = nation_edges(t).select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    targets = t.nation.where("n_nationkey >= 15").select(F.col("n_nationkey").cast("bigint").alias("target"))
    return ontology.by_hops(maps, isa, maps.select("source"), targets, hops=2).drop("rels")


@query(
    "thyroid_stage",
    """with c as (select c_custkey, (c_custkey % 80)::int as age, 'pT' || (1 + c_custkey % 4) || case when c_custkey % 3 = 0 then 'a' when c_custkey % 3 = 1 then 'b' else '' end as t, 'cN' || (c_custkey % 2) || case when c_custkey % 5 = 0 then 'a' else 'b' end as n, 'M' || (c_custkey % 7 // 6) as m, ['papillary', 'follicular', 'medullary', 'anaplastic', 'other'][c_custkey % 5 + 1] as h from customer)
select c_custkey, case when h in ('papillary', 'follicular') then case when age < 55 then case when m like '%M1%' then 'II期' else 'I期' end when m like '%M1%' then 'IVB期' when t like '%T4b%' then 'IVA期' when t like '%T4a%' then 'III期' when t like '%T3%' or n like '%N1%' then 'II期' else 'I期' end
when h = 'medullary' then case when m like '%M1%' then 'IVC期' when t like '%T4b%' then 'IVB期' when t like '%T4a%' or n like '%N1b%' then 'IVA期' when n like '%N1a%' then 'III期' when t like '%T2%' or t like '%T3%' then 'II期' else 'I期' end
when h = 'anaplastic' then case when m like '%M1%' then 'IVC期' when t like '%T4%' or n like '%N1%' then 'IVB期' else 'IVA期' end else '无法判定' end as stage from c""",
)
def stage(spark, sf):
    k = F.col("c_custkey")
    suffix = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("")
    t = F.concat(F.lit("pT"), 1 + k % 4, suffix)
    n = F.concat(F.lit("cN"), k % 2, F.when(k % 5 == 0, "a").otherwise("b"))
    m = F.concat(F.lit("M"), F.floor(k % 7 / 6))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("papillary", "follicular", "medullary", "anaplastic", "other")]), (k % 5 + 1).cast("int"))
    return Tables(spark, sf).customer.select("c_custkey", ontology.thyroid_stage((k % 80).cast("int"), t, n, m, kind).alias("stage"))


@query("decision_fold", "select user_id, (list(props order by event_id) filter (event_type = 'click'))[-1] as code, (list(event_type order by event_id) filter (value > 10))[-1] as kind from events group by 1")
def decisions(spark, sf):
    e = Tables(spark, sf).events
    rows = e.select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("props")).otherwise("").alias("code"), F.when(F.col("value") > 10, F.col("event_type")).alias("kind"))
    return ontology.folded_decisions(rows, ["user_id"], "event_id", ["code", "kind"])


@query("full_names", "select p_partkey as concept_id, coalesce((select string_agg(p_name || ' (' || l_linenumber || ')', '; ' order by l_orderkey, l_linenumber) from lineitem where l_partkey = p_partkey and l_returnflag = 'A'), '') as fsn from part")
def full_names(spark, sf):
    t = Tables(spark, sf)
    syn = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_returnflag") == "A", F.concat("p_name", F.lit(" ("), "l_linenumber", F.lit(")"))).otherwise(F.col("p_name"))
    syn = syn.select(F.col("p_partkey").alias("concept_id"), F.struct("l_orderkey", "l_linenumber").alias("pos"), name.alias("name"))
    return ontology.full_names(t.part.select(F.col("p_partkey").alias("concept_id")), syn)


@query("query_text", "select n_nationkey, case when n_regionkey = 0 then n_name else n_name || ' ' || r_name end as text from nation left join region on r_regionkey = n_regionkey")
def query_text(spark, sf):
    from docweave.functions.sized import small_side

    t = Tables(spark, sf)
    j = t.nation.join(small_side(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("n_nationkey", ontology.query_text(F.col("n_name"), F.when(F.col("n_regionkey") != 0, F.col("r_name"))).alias("text"))


@query("filter_tidy", f"with {EDGES_SQL}, n as (select n_nationkey as id from nation where n_regionkey <> 2) select src, dst from e where type <> 'RELATED_TO' and src in (select id from n) and dst in (select id from n)")
def tidy(spark, sf):
    t = Tables(spark, sf)
    nodes = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.when(F.col("n_regionkey") != 2, "d").alias("description"))
    edges = nation_edges(t).withColumn("description", F.when(F.col("type") != "RELATED_TO", F.col("type")))
    return predicates.tidy(nodes, edges)[1].select("src", "dst")


@query("latest_version", "select c_custkey, o_orderkey, o_totalprice from (select o_custkey as c_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) where n = 1")
def latest(spark, sf):
    o = Tables(spark, sf).orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return ontology.latest(o, ["c_custkey"], "o_orderkey")

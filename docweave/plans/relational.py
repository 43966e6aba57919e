"""Queries over filters, joins, aggregates and ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import aggregates, joins, predicates, windows
from docweave.plans.registry import Tables, query


@query("filter_conjunctive", "select doc_id, lang, source from documents where lang = 'fr' and source in ('src0', 'src1')")
def filter_conjunctive(spark, sf):
    d = Tables(spark, sf).documents
    return d.where(predicates.matching({"lang": "fr", "source": ["src0", "src1"]})).select("doc_id", "lang", "source")


@query("filter_bulk_ids", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def filter_bulk(spark, sf):
    t = Tables(spark, sf)
    ids = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return predicates.bulk(t.lineitem, ids, "l_orderkey", ["l_orderkey", "l_linenumber"])


@query("project_typed", "select c_custkey, coalesce(c_name, '') as c_name, c_nationkey, c_acctbal, coalesce(c_mktsegment, '') as c_mktsegment from customer")
def project_typed(spark, sf):
    return predicates.typed(Tables(spark, sf).customer, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "absent"])


@query("list_documents", "select doc_id, source as doc_type, n_chars from documents where lang = 'en' order by doc_id desc")
def list_documents(spark, sf):
    return Tables(spark, sf).documents.where("lang = 'en'").drop("text", "lang").withColumnRenamed("source", "doc_type").orderBy(F.desc("doc_id"))


@query("missing_fields", "select c_custkey, array_to_string(list_filter(list_value(case when c_name = '' then 'c_name' end, case when nullif(c_mktsegment, 'BUILDING') is null then 'segment' end), lambda x: x is not null), ',') as missing from customer")
def missing_fields(spark, sf):
    c = Tables(spark, sf).customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.select("c_custkey", F.array_join(predicates.missing_fields(["c_name", "segment"]), ",").alias("missing"))


@query("both_ends", "select o_orderkey as src, o_custkey as dst from orders where o_orderkey in (select l_orderkey from lineitem) and o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def both_ends(spark, sf):
    t = Tables(spark, sf)
    edges = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    edges = edges.join(t.lineitem.select(F.col("l_orderkey").alias("src")), "src", "left_semi")
    return edges.join(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("dst")), "dst", "left_semi").select("src", "dst")


@query("dangling_edges", "select o_custkey as src, c_nationkey as dst from orders join customer on c_custkey = o_custkey where o_custkey not in (select c_custkey from customer where c_acctbal > 0) or c_nationkey not in (select c_custkey from customer where c_acctbal > 0)")
def dangling(spark, sf):
    t = Tables(spark, sf)
    edges = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
    return joins.dangling(edges, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query(
    "range_join_first",
    """with r as (select user_id, event_id as rid, value as lo, value + 5 as hi from events where event_type = 'signup'), p as (select user_id, event_id, value from events where event_type = 'click')
select user_id, event_id, rid from (select p.user_id, p.event_id, rid, row_number() over (partition by p.event_id order by lo, rid) as n from p join r on p.user_id = r.user_id and value between lo and hi) where n = 1""",
)
def range_join(spark, sf):
    e = Tables(spark, sf).events
    r = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("rid"), F.col("value").alias("lo"), (F.col("value") + 5).alias("hi"))
    p = e.where("event_type = 'click'").select("user_id", "event_id", "value")
    return joins.in_range_first(p, r, "user_id", "value", "lo", "hi", "rid").select("user_id", "event_id", "rid")


@query("attribute_join", "select s_suppkey, s_name, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def attribute_join(spark, sf):
    from docweave.functions.sized import small_side

    t = Tables(spark, sf)
    out = t.supplier.join(small_side(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.join(small_side(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("zip_join", "select l_orderkey, unnest(list(l_partkey order by l_linenumber, l_partkey, l_suppkey)) as part, unnest(list(l_suppkey order by l_linenumber, l_partkey, l_suppkey)) as supp from lineitem group by 1")
def zip_join(spark, sf):
    rows = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    z = joins.zipped(F.transform("a", lambda x: x["l_partkey"]), F.transform("a", lambda x: x["l_suppkey"]))
    return rows.select("l_orderkey", F.inline(z).alias("part", "supp"))


@query("upsert_rows", "select c_custkey, case when c_acctbal < 0 then 'UPDATED' else c_mktsegment end as c_mktsegment, case when c_acctbal < 0 then 0.0 else c_acctbal end as c_acctbal from customer")
def upsert(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_acctbal < 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return joins.upsert(c, new, ["c_custkey"])


@query("majority_first", "select user_id, event_type from (select *, row_number() over (partition by user_id order by n desc, first) as r from (select user_id, event_type, count(*) as n, min(event_id) as first from events group by 1, 2)) where r = 1")
def majority(spark, sf):
    return aggregates.majority(Tables(spark, sf).events, ["user_id"], "event_type", "event_id")


@query("sorted_distinct_concat", "select user_id, string_agg(distinct event_type, '<SEP>' order by event_type) as types from events group by 1")
def concat(spark, sf):
    return Tables(spark, sf).events.groupBy("user_id").agg(aggregates.joined("event_type").alias("types"))


@query("merged_id_lists", "select o_custkey, list(distinct l_suppkey order by l_suppkey) as ids from orders join lineitem on o_orderkey = l_orderkey group by 1")
def merged_lists(spark, sf):
    t = Tables(spark, sf)
    each = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    return t.orders.join(each, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(aggregates.merged_ids("ids").alias("ids"))


@query("node_degree", "select id, count(*) as degree from (select l_suppkey as id from lineitem union all select l_partkey + 1000000 from lineitem) group by 1")
def degree(spark, sf):
    return aggregates.degrees(Tables(spark, sf).lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")))


PERCENTILE = "list_sort(list(value))[least(count(*) * {p} // 100, count(*) - 1) + 1] as p{p}"


@query("percentile_nearest", f"select event_type, {PERCENTILE.format(p=50)}, {PERCENTILE.format(p=95)}, {PERCENTILE.format(p=99)} from events group by 1")
def percentile(spark, sf):
    return aggregates.percentile(Tables(spark, sf).events, ["event_type"], "value", [50, 95, 99])


@query(
    "latency_summary",
    """select user_id, count(*) as n, avg((event_type <> 'error')::int) as success_rate, max(value) filter (event_type <> 'error') as slowest,
(list_sort(list(value) filter (event_type <> 'error')))[least(count(*) filter (event_type <> 'error') * 50 // 100, count(*) filter (event_type <> 'error') - 1) + 1] as p50,
(list_sort(list(value) filter (event_type <> 'error')))[least(count(*) filter (event_type <> 'error') * 95 // 100, count(*) filter (event_type <> 'error') - 1) + 1] as p95 from events group by 1""",
)
def latency(spark, sf):
    return aggregates.latency_summary(Tables(spark, sf).events.select("user_id", F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok")), ["user_id"])


@query("qps", "select user_id, count(*) filter (event_type <> 'error') / max(value) filter (event_type <> 'error') as qps, avg(event_id % 5) filter (event_type <> 'error') as mean_chunks from events group by 1")
def qps(spark, sf):
    e = Tables(spark, sf).events
    return aggregates.qps(e.select("user_id", F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 5).alias("chunks")), ["user_id"])


@query("outcome_counts", "select user_id, count(*) as total, count(*) filter (event_type = 'click') as success, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type = 'view') as timeout from events group by 1")
def outcome_counts(spark, sf):
    status = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "timeout")
    return aggregates.outcomes(Tables(spark, sf).events.withColumn("status", status), ["user_id"], "status")


@query(
    "parse_quality",
    """with p as (select source as doc_id, count(*) as pages, sum((length(trim(text, ' ')) < 200)::int) as empty_pages, avg(length(trim(text, ' '))) as avg_length from documents group by 1)
select doc_id, pages, empty_pages::bigint as empty_pages, avg_length, empty_pages / pages as empty_ratio, case when empty_pages / pages > 0.8 then 'fail' when empty_pages / pages > 0.3 then 'warn' when avg_length < 100 then 'warn' else 'ok' end as verdict from p""",
)
def parse_quality(spark, sf):
    return aggregates.parse_quality(Tables(spark, sf).documents.select(F.col("source").alias("doc_id"), "text"), few=200)


@query("intent_accuracy", "select round(avg((quality = (n_chars > 200)::int)::int), 4) as accuracy, count(*) as n from labels join documents using (doc_id) where quality is not null")
def accuracy(spark, sf):
    t = Tables(spark, sf)
    rows = t.labels.join(t.documents, "doc_id").withColumn("predicted", (F.col("n_chars") > 200).cast("int"))
    return aggregates.accuracy(rows, "quality", "predicted")


@query("duplicate_keys", "select text, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_keys(spark, sf):
    return aggregates.duplicates(Tables(spark, sf).documents, ["text"])


@query("cache_gain", "select 1 - avg(value) filter (run > 1) / max(value) filter (run = 1) as drop from (select value, row_number() over (order by event_id) as run from events)")
def cache_gain(spark, sf):
    e = Tables(spark, sf).events
    first = e.agg(F.min("event_id").alias("f"))
    return aggregates.cache_gain(e.join(F.broadcast(first)).withColumn("run", F.when(F.col("event_id") == F.col("f"), 1).otherwise(2)), "run", "value")


@query("neighbour_rows", "select user_id, event_id, lag(event_id) over w as prev_event_id, lead(event_id) over w as next_event_id from events window w as (partition by user_id order by event_id)")
def neighbour_rows(spark, sf):
    return windows.neighbours(Tables(spark, sf).events.select("user_id", "event_id"), ["user_id"], "event_id", "event_id")


@query(
    "page_carry",
    """with e as (select user_id, event_id, case when event_type = 'view' then event_id % 9 end as first, 1 as n from events)
select user_id, event_id, coalesce(first, last_value(first + n ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 1)::int as page from e""",
)
def page_carry(spark, sf):
    marks = F.when(F.col("event_type") == "view", F.array((F.col("event_id") % 9).cast("int"))).otherwise(F.array().cast("array<int>"))
    return windows.carried_page(Tables(spark, sf).events.select("user_id", "event_id", marks.alias("markers")), ["user_id"], "event_id").drop("markers")


DAILY_SQL = "d as (select event_type, cast(date_trunc('month', ts) as date) as month, round(sum(value), 4) as total from events group by 1, 2), c as (select *, (total - lag(total) over w) / lag(total) over w as change from d window w as (partition by event_type order by month))"


def monthly(spark, sf):
    e = Tables(spark, sf).events
    return e.groupBy("event_type", F.trunc("ts", "month").alias("month")).agg(F.round(F.sum("value"), 4).alias("total"))


@query("trend_change", f"with {DAILY_SQL} select event_type, month, total, round(change, 9) as change from c")
def trend(spark, sf):
    return windows.trend(monthly(spark, sf), ["event_type"], "month", "total").withColumn("change", F.round("change", 9))


@query("turning_points", f"with {DAILY_SQL}, n as (select *, lead(change) over (partition by event_type order by month) as nxt from c) select event_type, month, coalesce(nxt > 2 * change and nxt > 0.3, false) as inflection, coalesce(change > 0.1 and nxt < 0.3 * change, false) as plateau from n")
def turning(spark, sf):
    return windows.turning_points(monthly(spark, sf), ["event_type"], "month", "total").select("event_type", "month", "inflection", "plateau")


@query("history_last_n", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 3")
def last_n(spark, sf):
    return windows.last_n(Tables(spark, sf).conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", 3)


@query(
    "carry_last_key",
    "select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as signup from events",
)
def carry(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("v"))
    return windows.carried(e, ["user_id"], "event_id", "v", "signup").drop("v")


@query("top_per_key", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value, event_id) as n from events) where n = 1")
def top_per_key(spark, sf):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return Tables(spark, sf).events.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "value")


@query("set_operations", "select user_id, list_sort(list_intersect(a, b)) as both, list_sort(list_filter(a, lambda x: not list_contains(b, x))) as only_a from (select user_id, list(distinct hour(ts)) filter (event_type = 'click') as a, list(distinct hour(ts)) filter (event_type = 'view') as b from events group by 1) where a is not null and b is not null")
def sets(spark, sf):
    hour = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, F.hour("ts").cast("bigint")))
    rows = Tables(spark, sf).events.groupBy("user_id").agg(hour("click").alias("a"), hour("view").alias("b")).where("size(a) > 0 and size(b) > 0")
    return rows.select("user_id", F.array_sort(F.array_intersect("a", "b")).alias("both"), F.array_sort(F.array_except("a", "b")).alias("only_a"))


@query("json_field", "select event_id, (props->>'$.k')::bigint as k from events")
def json_field(spark, sf):
    return Tables(spark, sf).events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("sanitised_names", "select page_id, regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g') as name from pages")
def sanitised(spark, sf):
    return Tables(spark, sf).pages.select("page_id", tx.sanitised_name(F.col("url")).alias("name"))


@query("hashed_ids", "select l_orderkey, l_linenumber, ('0x' || substr(sha256(l_orderkey || ':' || l_linenumber || ':' || l_returnflag), 1, 15))::bigint as id, 'k:' || md5(l_orderkey || '|' || l_linenumber) as key from lineitem")
def hashed(spark, sf):
    c = [F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_returnflag")]
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", tx.hashed_id(*c).alias("id"), tx.args_key("k", *c[:2]).alias("key"))


@query("float_literals", "select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_full_match(x, '[-+]?[0-9]*\\.?[0-9]+')) as numbers from documents")
def floats(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.filter(F.split("text", r"[\t\n\f\r ]+"), tx.is_float).alias("numbers"))


@query("token_estimate", "select doc_id, length(text) // 4 as tokens from documents")
def estimate(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", tx.tokens_estimate(F.col("text")).alias("tokens"))


@query("reply_clean", "select doc_id, rtrim('Answer: ' || trim(regexp_replace(text, '```[a-zA-Z]*', '', 'g'), ' ' || chr(9) || chr(10) || chr(34) || chr(39))) as reply from documents")
def reply_clean(spark, sf):
    raw = F.concat(F.lit('<think>why\nnot</think>```json\n输出: "Answer: '), F.regexp_replace("text", "^[ \t\n\"']+|[ \t\n\"']+$", ""), F.lit('"```'))
    return Tables(spark, sf).documents.select("doc_id", tx.cleaned_reply(raw).alias("reply"))


@query("stream_latest", "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as step from events group by 1")
def stream_latest(spark, sf):
    """The last step of each user, from a stream over the events' files that takes what is there."""
    from docweave.functions.shared import shared_path
    from docweave.streaming import jobs

    place = shared_path(spark, "stream")
    schema = Tables(spark, sf).events.schema
    rows = lambda df: df.select("user_id", "event_id", F.col("event_type").alias("step"))
    work = lambda df, n: jobs.latest(rows(df), "user_id", "event_id", ["step"]).write.mode("overwrite").parquet(f"{place}/out/batch={n}")
    jobs.ingest(spark, f"{sf}/events*.parquet", schema, work, f"{place}/state").awaitTermination()
    return jobs.latest(spark.read.parquet(f"{place}/out"), "user_id", "event_id", ["step"])


@query("job_status", "select user_id, case when n is null then 'not_found' when n = 0 then 'pending' when n < 7 then 'started' else 'finished' end as status from (select user_id, count(*) filter (event_type = 'purchase') as n from events group by 1)")
def job_status(spark, sf):
    from docweave.streaming import jobs

    steps = Tables(spark, sf).events.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("n"))
    return steps.select("user_id", jobs.status(F.col("n")).alias("status"))


@query("state_fold", "select conv_id, (list(text order by turn) filter (role = 'user' and turn <= 4 and text <> ''))[-1] as user, (list(text order by turn) filter (role = 'assistant' and turn <= 4 and text <> ''))[-1] as assistant from conversations group by 1 having count(*) filter (turn <= 4 and text <> '') > 0")
def state_fold(spark, sf):
    from docweave.streaming import state

    c = Tables(spark, sf).conversations
    events = c.select(F.col("conv_id").alias("thread"), F.lit("main").alias("branch"), F.col("turn").alias("seq"), F.col("role").alias("key"), F.col("text").alias("value"))
    out = state.state_at(events, 4)
    return out.select(F.col("thread").alias("conv_id"), F.try_element_at("state", F.lit("user")).alias("user"), F.try_element_at("state", F.lit("assistant")).alias("assistant"))


@query("message_log", "select conv_id, list(role order by turn) as log from conversations group by 1")
def message_log(spark, sf):
    from docweave.streaming import state

    return state.log(Tables(spark, sf).conversations.select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("payload")), ["conv_id"])


@query("parser_choice", "select page_id, case page_id % 3 when 0 then 'pdf' when 1 then 'text' end as parser from pages")
def parser_choice(spark, sf):
    from docweave.sources.readers import parser_of

    m = F.col("page_id") % 3
    name = F.when(m == 0, "Doc.PDF").when(m == 1, "noext").otherwise("pic.png")
    kind = F.when(m == 1, "Text/Markdown; charset=utf-8").otherwise("image/png")
    return Tables(spark, sf).pages.select("page_id", parser_of(name, kind).alias("parser"))

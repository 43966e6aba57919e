"""Near duplicates: bottom-k sketches from one hash function, inverted lists, union sketches, exact Jaccard.

A document's sketch holds the k smallest hashes of its shingles. Documents whose similarity is
0.75 share about three quarters of the k smallest hashes of their union, so two sketches that
share fewer than ``need`` (3/8 of k) belong to a pair below it, but for a chance of about 5e-11.
Two sets that share so many values share one of the k - need + 1 values that either holds first
in any common order; the order puts values of long lists last. Inverted lists of these values
give the candidates. Lists of at most ``LIST`` documents give all pairs; longer ones give pairs
with pivots, which join most of a group of copies. What is left apart in them goes through
inverted lists of full sets, rarest values first: two linked sets of n share 6/7 of n values, so
the first that they share is among the n/7 + 1 rarest of both, and these are seldom common ones
in a document that is far from its group. Union sketches estimate the similarity and drop what is
far below; the full sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.graph import components
from docweave.llm.tables import cut, map_text, release, sized, small, trim, whole_id
from docweave.llm.words import distinct, mix, scan, spaced, windows

#: Words of a shingle, and similarity in hundredths from which documents are linked.
SHINGLE, PERCENT = 5, 75
#: Values of a sketch.
K = 64
#: Documents of a list that gives all its pairs.
LIST = 32
#: Of a document's values in longer lists, so many of the most common ones lead to pivots.
PIVOTS = 4
#: Pivots of a longer list.
AROUND = 8
#: Sketches that a task takes apart at once.
ROWS = 1_000
#: Standard deviations of the estimate that a pair may lie below the similarity.
SLACK = 6


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a text of fewer words is one shingle."""
    w = scan(texts, spaced(), lower=True)
    grams, out = windows(w.hash, n), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        out.append(distinct(grams[a : b - n + 1] if b - a >= n else windows(w.hash[a:b], b - a) if b > a else grams[:0]))
    return out


def _sketches(texts: pa.Array, n: int, k: int) -> list:
    sizes, one, two, sketch = [], [], [], []
    for s in shingle_sets(texts, n):
        sizes.append(len(s))
        one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
        two.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
        sketch.append(s[:k].view(np.int64))
    return [sizes, one, two, sketch]


def need(n: int, k: int, percent: int) -> int:
    """Values that the sketch of a set of n must share with that of a set linked to it."""
    exact = -(-percent * n // 100)
    return exact if n * 100 <= percent * k else min(exact, k * 3 // 8)


def _first_values(ids, sizes, sketches, values: np.ndarray, lengths: np.ndarray, k: int, percent: int):
    """What each sketch holds first: rare values by value, then those of long lists by length; and how many are of these.

    ``values`` are the sorted values of long lists, ``lengths`` how many documents each has.
    """
    for i, n, s in zip(ids, sizes, sketches, strict=True):
        s = np.asarray(s, np.int64)
        at = np.minimum(np.searchsorted(values, s), max(len(values) - 1, 0))
        length = np.where(values[at] == s, lengths[at], 0) if len(values) else np.zeros(len(s), np.int64)
        by = np.lexsort((s, length))[: len(s) - need(n, k, percent) + 1]
        often = by[length[by] > 0]
        rare = by[: len(by) - len(often)]
        yield i, n, int((length > 0).sum()), s[np.concatenate([rare, often[-PIVOTS:]])], len(rare)


def _first_rows(batch: pa.RecordBatch, values: np.ndarray, lengths: np.ndarray, k: int, percent: int) -> pa.RecordBatch:
    """(id, n, common, first) of rows (id, n, sketch)."""
    rows = list(_first_values(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), values, lengths, k, percent))
    ids, sizes, common, found, rare = zip(*rows, strict=True)
    counts = [len(x) for x in found]
    long = np.concatenate([np.arange(c) >= r for c, r in zip(counts, rare, strict=True)])
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(long)], ["value", "long"])
    first = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pairs)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(common, pa.int32()), first], names=["id", "n", "common", "first"])


def list_rows(reps: DataFrame, popular: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, common, value, long) of the values that each sketch holds first; common: its values of long lists."""
    if small(popular):
        table = popular.orderBy("value").toArrow()  # bounded by small()
        held = reps.sparkSession.sparkContext.broadcast((np.asarray(table["value"], np.int64), np.asarray(table["n"], np.int64)))

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    yield _first_rows(b.slice(at, ROWS), *held.value, k, percent)
            trim()

        return reps.select("id", "n", "sketch").mapInArrow(run, "id bigint, n bigint, common int, first array<struct<value: bigint, long: boolean>>").select("id", "n", "common", F.inline("first"))
    rows = reps.select("id", "n", F.explode("sketch").alias("value")).join(popular.select("value", F.col("n").alias("length")), "value", "left")
    each = F.array_sort(F.collect_list(F.struct(F.coalesce("length", F.lit(0)).alias("length"), "value")))
    exact = F.ceil(F.col("n") * percent / 100)
    asked = F.when(F.col("n") * 100 <= percent * k, exact).otherwise(F.least(exact, F.lit(k * 3 // 8)))
    rows = rows.groupBy("id", "n").agg(each.alias("each"), F.count("length").cast("int").alias("common"))
    first = F.slice("each", F.lit(1), (F.size("each") - asked + 1).cast("int"))
    rare, often = F.filter("first", lambda x: x["length"] == 0), F.filter("first", lambda x: x["length"] > 0)
    rows = rows.withColumn("first", first).withColumn("x", F.explode(F.concat(rare, F.reverse(F.slice(F.reverse(often), 1, PIVOTS)))))
    return rows.select("id", "n", "common", "x.value", (F.col("x.length") > 0).alias("long"))


def _near(n1: str, n2: str, percent: int):
    return (F.least(n1, n2) * 100) >= (F.greatest(n1, n2) * percent)


def likely(pairs: DataFrame, reps: DataFrame, *, k: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that the sketch of their union does not put far below the similarity."""
    pairs = cut(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "pairs")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sketch = reps.select("id", "sketch").join(sized(ids), "id", "left_semi")
    both = pairs.join(sketch.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(sketch.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")
    # the union's sketch: its k smallest values; the share of them in both sketches estimates
    both = both.withColumn("su", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    share = F.size(F.array_intersect(F.array_intersect("su", "sa"), "sb")) / F.size("su")
    p = percent / 100
    floor = F.lit(p) - SLACK * F.sqrt(F.lit(p * (1 - p)) / F.size("su"))
    out = cut(both.where(share >= floor).select("a", "b"), "likely")
    release(pairs, ids)
    return out


def exact(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The written pairs (a, b) whose full sets are similar enough.

    The set of a travels once, that of b once for each of its pairs, and they meet by a.
    """
    sets = lambda d, keep: map_text(d, "text", keep, "s array<bigint>", lambda t: [[x.view(np.int64) for x in shingle_sets(t, shingle)]])
    left = sets(docs.join(sized(cut(pairs.select(F.col("a").alias("id")).distinct(), "ids")), "id", "left_semi"), ["id"])
    right = sets(docs.join(sized(pairs.withColumnsRenamed({"a": "x", "b": "id"})), "id"), ["x", "id"]).withColumnsRenamed({"id": "b", "s": "sb"})
    common = F.size(F.array_intersect("s", "sb"))
    met = left.join(right, (F.col("id") == F.col("x")) & (common * 100 >= (F.size("s") + F.size("sb") - common) * percent))
    return cut(met.select(F.col("x").alias("a"), "b"), "links")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), links whose components are those of all links among them.

    Every document is first compared with the smallest of its partners; of the other pairs those
    that are still in different components then are compared.
    """
    first = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = exact(first, docs, shingle, percent)
    rest = pairs.join(sized(first), ["a", "b"], "left_anti")
    labels = components(links, pairs.sparkSession)
    end = lambda x: sized(labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")))
    rest = rest.join(end("a"), "a", "left").join(end("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    rest = cut(rest.select("a", "b"), "rest")
    release(first, labels)
    if not rest.take(1):
        return links
    out = cut(links.unionByName(exact(rest, docs, shingle, percent)), "links")
    release(links, rest)
    return out


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents of the short lists."""
    lists = rows.groupBy("value").agg(F.collect_list(F.struct("id", "n")).alias("docs")).where(F.size("docs") > 1)
    one = lists.select("docs", F.explode("docs").alias("x"))
    two = one.select("x", F.explode("docs").alias("y")).where("x.id < y.id")
    return two.where(_near("x.n", "y.n", percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def pivot_pairs(rows: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs of the long lists' documents with their list's pivots, where their components differ.

    ``rows`` has value, id, n, common and component. One pivot is the document with most common
    values, likely the source of copies; hashes choose the others.
    """
    ends = F.struct("id", "n", "component")
    some = [F.max_by(ends, F.struct("common", F.xxhash64("id"))), *(F.max_by(ends, F.xxhash64("id", F.lit(seed + i))) for i in range(1, AROUND))]
    pivots = rows.groupBy(F.col("value").alias("v")).agg(F.array_distinct(F.array(*some)).alias("p")).select("v", F.explode("p").alias("p"))
    met = rows.join(sized(cut(pivots, "pivots")), (F.col("value") == F.col("v")) & (F.col("component") != F.col("p.component")) & _near("n", "p.n", percent))
    return met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))


def full_lists(ids: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, n, pos, value): inverted lists of the full sets of the documents that are named, by their rarest values.

    Values are ordered by how many of these documents hold them. Linked sets of n and m values
    share p/(1+p) (n + m) at least, so the first value that they share has so many from it on in
    both. The lists hold no sets: a document's are its id, size and the value's place.
    """
    held_by = map_text(docs.join(sized(ids), "id", "left_semi"), "text", ["id"], "s array<bigint>", lambda t: [[x.view(np.int64) for x in shingle_sets(t, shingle)]])
    values = held_by.select("id", F.size("s").alias("n"), F.explode("s").alias("value"))
    held = cut(values.groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    met = values.join(sized(held), "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("each"))
    met = met.select("id", "n", F.posexplode("each").alias("i", "x"), (F.col("n") - F.size("each")).alias("alone"))
    pos = F.col("alone") + F.col("i")  # values that no other document has come first
    met = met.where(pos <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    return cut(met.select("id", "n", pos.alias("pos"), F.col("x.value").alias("value")), "lists")


def apart_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components that share a value of full_lists() first.

    In each list, documents outside its largest component meet all others.
    """
    sizes = lists.groupBy("value", "component").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("value").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = cut(main.select("value", "main"), "main")
    lists = lists.join(sized(main), "value")
    rest = lists.where("component <> main").select("value", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("pos").alias("px"))
    least = F.ceil((F.col("n") + F.col("nx")) * percent / (100 + percent))
    near = (F.col("pos") <= F.col("n") - least) & (F.col("px") <= F.col("nx") - least) & _near("n", "nx", percent)
    other = lists.withColumnRenamed("value", "v")
    once = (F.col("component") == F.col("main")) | (F.col("id") < F.col("x"))
    found = other.join(rest, (other.v == rest.value) & (F.col("component") != F.col("cx")) & once & near)
    return found.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))


def placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with their component, their own id where nothing is linked."""
    return rows.join(sized(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    Texts with equal sets are one class, named by its smallest id; links are sought between
    classes. component_id is the smallest id that links reach, kept whether it is the document's
    own. Null and empty texts have no shingles and are linked with nothing. Rows without an id
    are linked with nothing, have no component and are kept; rows of equal ids are one document
    with several texts. Ids that are no whole numbers are refused. Extra columns are left out. A
    task holds the sets of a batch of texts; that of the longest text takes about 60 times its size.
    """
    spark = docs.sparkSession
    base = docs.select(whole_id(docs, doc_id).alias("id"), F.col(f"`{text}`").alias("text"))
    marks = cut(map_text(base, "text", ["id"], "n bigint, s1 bigint, s2 bigint, sketch array<bigint>", lambda t: _sketches(t, shingle, k)), "sketches")
    mine = marks.where("id is not null and n > 0")
    classes = cut(mine.groupBy("n", "s1", "s2").agg(F.min("id").alias("class")), "classes")
    names = sized(classes.select(F.col("class").alias("id"), "n", "s1", "s2"))
    reps = cut(mine.join(names, ["id", "n", "s1", "s2"], "left_semi").dropDuplicates(["id", "n", "s1", "s2"]).select("id", "n", "sketch"), "reps")
    texts = base.join(sized(classes.select(F.col("class").alias("id")).distinct()), "id", "left_semi")
    popular = cut(reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST), "popular")
    rows = list_rows(reps, popular, k, percent)
    long = cut(rows.where("long").select("id", "n", "common", "value"), "long")
    met = all_pairs(rows.where("not long"), percent).unionByName(pivot_pairs(long.withColumn("component", F.col("id")), percent, 0))
    pairs = likely(met, reps, k=k, percent=percent)
    links = confirmed(pairs, texts, shingle, percent)
    release(popular, pairs)
    ids = cut(long.select("id").distinct(), "ids")
    labels = components(links, spark)
    if placed(ids, labels).select("component").distinct().limit(2).count() > 1:
        lists = full_lists(ids, texts, shingle, percent)
        for search in (lambda x: pivot_pairs(x.withColumn("common", F.lit(0)), percent, AROUND), lambda x: apart_pairs(x, percent)):
            pairs = likely(search(placed(lists, labels)), reps, k=k, percent=percent)
            more = confirmed(pairs, texts, shingle, percent)
            release(pairs)
            if more.take(1):
                links = links.unionByName(more)
                release(labels)
                labels = components(links, spark)
        release(lists)
    release(reps, long, ids)
    named = sized(classes.join(sized(labels), F.col("class") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component", "class").alias("component")))
    marks = marks.select("id", "n", "s1", "s2")
    linked = marks.where("id is not null and n > 0").join(named, ["n", "s1", "s2"], "left").select("id", "n", "component")
    alone = marks.where("id is null or n = 0").select("id", "n", F.col("id").alias("component"))  # one key for all would be hot
    return linked.unionByName(alone).select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def op6_near_dup(spark, sf_dir: str) -> DataFrame:
    """Shingles, component and verdict of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")

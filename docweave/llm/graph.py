"""Connected components of links: of few on the driver, of more round by round in written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.tables import cut, release, sized, small

#: Links whose components the driver finds, in about 100 bytes each.
FEW = 500_000


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) from (id, parent) with parent < id: pointers double until none moves."""
    at = cut(parents.select("id", F.col("parent").alias("root")), "roots")
    while True:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("above"))
        step = cut(at.join(sized(up), "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        release(at)
        at = step.select("id", "root")
        if not step.where("moved").take(1):
            return at


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the links a - b, in order, and the smallest that each reaches."""
    ids = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(above := root[root], root):
            root = above
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return ids, ids[root]


def components(links: DataFrame, spark: SparkSession, few: int = FEW) -> DataFrame:
    """(id, component) of every end of the links (a, b): the smallest id that it reaches.

    At most ``few`` links go to the driver. Of more, each round hangs every node on its smallest
    neighbour, follows these pointers to their ends and contracts the links; nodes that still have
    links halve at least.
    """
    labels = None
    links = cut(links.select("a", "b").where("a <> b").distinct(), "links")
    if small(links, few):
        found = links.toArrow()  # bounded by few
        release(links)
        ids, roots_of = labelled(*(found[c].to_numpy().astype(np.int64) for c in ("a", "b")))
        rows = pa.table({"id": ids, "component": roots_of})
        return cut(spark.createDataFrame(rows, "id bigint, component bigint"), "labels")
    while links.take(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent"))
        low = cut(low.withColumn("parent", F.least("id", "parent")), "low")
        ends = roots(low.where("parent < id"))
        top = sized(ends)
        if labels is None:
            new = cut(low.join(top, "id", "left").select("id", F.coalesce("root", "id").alias("component")), "labels")
        else:
            new = cut(labels.join(top.select(F.col("id").alias("component"), "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
            release(labels)
        labels = new
        a, b = top.select(F.col("id").alias("a"), F.col("root").alias("ra")), top.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved = links.join(sized(a), "a", "left").join(sized(b), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        left = cut(moved.where("a <> b").distinct(), "links")
        release(links, low, ends)
        links = left
    release(links)
    return spark.createDataFrame([], "id bigint, component bigint") if labels is None else labels

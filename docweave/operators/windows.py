"""Order-dependent operators (WIN1-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, keys: list[str], order: str, id_: str) -> DataFrame:
    """Ids of the row before and after (WIN1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"prev_{id_}": F.lag(id_).over(w), f"next_{id_}": F.lead(id_).over(w)})


def carried_page(chunks: DataFrame, keys: list[str], order: str, start: int = 1) -> DataFrame:
    """Each chunk's page (WIN2): its first marker, else what the last marked chunk left open.

    ``chunks`` has markers, an array of page numbers; after a chunk with markers the next page is
    its first marker plus their count.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    has = F.size("markers") > 0
    left = F.last(F.when(has, F.element_at("markers", 1) + F.size("markers")), ignorenulls=True).over(w)
    return chunks.withColumn("page", F.when(has, F.try_element_at("markers", F.lit(1))).otherwise(F.coalesce(left, F.lit(start))))


def parents(titles: DataFrame, keys: list[str], pos: str, level: str, levels: int = 4) -> DataFrame:
    """parent: the nearest earlier title of lower level, else 0 (WIN3)."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col(level) == n, F.col(pos)), ignorenulls=True).over(w) for n in range(1, levels)}
    pick = F.lit(0).cast("bigint")
    cases = None
    for n in range(2, levels + 1):
        value = F.greatest(F.lit(0).cast("bigint"), *[F.coalesce(last[m].cast("bigint"), F.lit(0)) for m in range(1, n)])
        cases = F.when(F.col(level) == n, value) if cases is None else cases.when(F.col(level) == n, value)
    return titles.withColumn("parent", cases.otherwise(pick))


def ranges(starts: DataFrame, keys: list[str], start: str, last: str) -> DataFrame:
    """end: one before the next start, the last one at ``last``; never before the start (WIN5)."""
    w = Window.partitionBy(*keys).orderBy(start)
    return starts.withColumn("end", F.greatest(F.col(start), F.coalesce(F.lead(start).over(w) - 1, F.col(last))))


def carried(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last non-null value up to each row (WIN6)."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def trend(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """change: relative difference to the level before (WIN7)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("change", F.try_divide(F.col(value) - before, before))


def turning_points(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """inflection: growth over .3 that more than doubles the one before; plateau: growth over .1 then under .3 of it (WIN8)."""
    rows = trend(rows, keys, order, value)
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = F.lead("change").over(w)
    return rows.withColumns({"inflection": F.coalesce((nxt > 2 * F.col("change")) & (nxt > 0.3), F.lit(False)), "plateau": F.coalesce((F.col("change") > 0.1) & (nxt < 0.3 * F.col("change")), F.lit(False))})


def combined(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (start, end, label, text) where a span that begins at the end of a mergeable one joins it (WIN9).

    A joined pair is skipped over, so a run of touching spans is joined two by two.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    touch = F.coalesce((F.lag("end").over(w) == F.col("start")) & F.lag("mergeable").over(w), F.lit(False))
    rows = spans.withColumn("run", F.sum(F.when(touch, 0).otherwise(1)).over(w))
    rows = rows.withColumn("pair", F.floor((F.row_number().over(Window.partitionBy(*keys, "run").orderBy("start")) - 1) / 2))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "")
    return rows.groupBy(*keys, "run", "pair").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", "start").alias("label"), text.alias("text")).drop("run", "pair")


def without_overlaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy by score: a span stays if it meets none that stays (WIN10); one group of keys at a time."""
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for i, r in rows.sort_values(["score", "start"], ascending=[False, True]).iterrows():
            if all(r.end <= rows.start[j] or r.start >= rows.end[j] for j in kept):
                kept.append(i)
        return rows.loc[kept].sort_values("start")

    return spans.groupBy(*keys).applyInPandas(pick, spans.schema)


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group (WIN11)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def numbered(keys: list[str], *order: Column | str) -> Column:
    """Ranks from 1 (WIN12)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))

"""Schema-driven extraction, validation, confidence and versioned replacement (EXT1-16).

Extracted values stand in long tables (doc_id, field, row, name, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def regex_fields(pages: DataFrame, fields: dict[str, tuple[str, int]]) -> DataFrame:
    """(doc_id, field, value, whole, page): the first page's match of each field's (regex, group) (EXT1)."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.regexp_extract("text", rx, g).alias("value"), F.regexp_extract("text", rx, 0).alias("whole")) for k, (rx, g) in fields.items()]))
    rows = pages.select("doc_id", "page", named.alias("x")).select("doc_id", "page", "x.*").where("whole <> ''")
    return rows.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "whole", "page"), "page").alias("m")).select("doc_id", "field", "m.*")


def _grids(html: str) -> list[list[list[tuple[str, bool, bool]]]]:
    """Tables of a page as grids of (text, heading, spanned) with row and column spans laid out."""
    from html.parser import HTMLParser

    tables: list = []

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.cell = None, None

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "table":
                self.rows = []
                tables.append(self.rows)
            elif tag == "tr" and self.rows is not None:
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                num = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
                self.cell = {"text": "", "th": tag == "th", "rows": num("rowspan"), "cols": num("colspan")}
                self.rows[-1].append(self.cell)

        def handle_data(self, data):
            if self.cell is not None:
                self.cell["text"] += data

        def handle_endtag(self, tag):
            if tag in ("td", "th"):
                self.cell = None
            elif tag == "table":
                self.rows = None

    Reader().feed(html or "")
    out = []
    for rows in tables:
        taken: dict[tuple[int, int], tuple[str, bool, bool]] = {}
        for i, row in enumerate(rows):
            j = 0
            for c in row:
                while (i, j) in taken:
                    j += 1
                for di in range(min(c["rows"], len(rows) - i)):
                    for dj in range(c["cols"]):
                        taken[i + di, j + dj] = (c["text"].strip(), c["th"], bool(di or dj))
                j += c["cols"]
        out.append([[taken[i, j] for j in sorted(y for x, y in taken if x == i)] for i in range(len(rows))])
    return out


def table_cells(pages: DataFrame) -> DataFrame:
    """(doc_id, page, tbl, row, col, text, heading, spanned) of all HTML tables (EXT2-4).

    A spanned place repeats its cell's text and is marked, so that it can be told from a cell.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(d, p, t, i, j, *c) for d, p, x in zip(b.doc_id, b.page, b.text, strict=True) for t, grid in enumerate(_grids(x)) for i, row in enumerate(grid) for j, c in enumerate(row)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "tbl", "row", "col", "text", "heading", "spanned"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page", "text").mapInPandas(run, f"doc_id {kind}, page int, tbl int, row int, col int, text string, heading boolean, spanned boolean")


def table_kinds(cells: DataFrame, first_headings: dict[str, list[str]]) -> DataFrame:
    """(doc_id, page, tbl, field): the field whose values hold a table's first heading (EXT2)."""
    first = cells.where("heading").groupBy("doc_id", "page", "tbl").agg(F.min_by("text", F.struct("row", "col")).alias("first"))
    case = F.lit(None).cast("string")
    for field, values in first_headings.items():
        case = F.when(F.col("first").isin(values), field).otherwise(case)
    return first.withColumn("field", case).where("field is not null").drop("first")


def list_rows(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """List tables as (doc_id, field, row, name, value): cells under the heading of their column (EXT3)."""
    keys = ["doc_id", "page", "tbl"]
    mine = cells.join(kinds, keys)
    heads = mine.where("heading").groupBy(*keys, "col").agg(F.min_by("text", "row").alias("name"))
    rows = mine.where("not heading and not spanned and text <> ''").join(heads, [*keys, "col"])
    place = F.dense_rank().over(Window.partitionBy("doc_id", "field").orderBy("page", "tbl", "row")) - 1
    return rows.select("doc_id", "field", place.alias("row"), "name", F.col("text").alias("value"))


def key_values(cells: DataFrame, ignored: list[str]) -> DataFrame:
    """(doc_id, page, tbl, row, name, value): cells of a row taken two by two, ignored words first dropped (EXT5).

    An odd last cell is dropped; of equal names the later value wins.
    """
    rows = cells.where(~F.col("spanned") & ~F.col("text").isin(ignored) & (F.col("text") != ""))
    rows = rows.groupBy("doc_id", "page", "tbl", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("t"))
    pairs = F.transform(F.expr("sequence(0, size(t) div 2)"), lambda i: F.struct(i.alias("i"), F.get("t", i * 2).alias("name"), F.get("t", i * 2 + 1).alias("value")))
    rows = rows.select("doc_id", "page", "tbl", "row", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p"))
    return rows.groupBy("doc_id", "page", "tbl", "row", F.col("p.name").alias("name")).agg(F.max_by("p.value", "p.i").alias("value"))


def missing(extracted: DataFrame, docs: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, field, name) expected but not extracted with a value (EXT7); expected has field, name."""
    wanted = docs.select("doc_id").distinct().join(F.broadcast(expected), how="cross")
    have = extracted.where("coalesce(value, '') <> ''").select("doc_id", "field", "name").distinct()
    return wanted.join(have, ["doc_id", "field", "name"], "left_anti")


def fill_only(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first source's values; the second fills what is missing or empty (EXT8)."""
    keys = ["doc_id", "field", "row", "name"]
    return first.join(second.withColumnRenamed("value", "other"), keys, "full_outer").select(*keys, F.coalesce(F.nullif("value", F.lit("")), "other").alias("value"))


def flattened(extracted: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per document, a column for each (field, name): its first row's value (EXT9)."""
    return extracted.groupBy("doc_id").agg(*[F.min_by(F.when((F.col("field") == f) & (F.col("name") == n), F.col("value")), F.when((F.col("field") == f) & (F.col("name") == n), F.col("row"))).alias(c) for c, (f, n) in columns.items()])


def with_attributes(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rows of a list field with the document's single values (EXT10, JN5)."""
    return rows.join(attributes, "doc_id", "left")


def replaced(old: DataFrame, new: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Versions (EXT11): old rows of a new key become "I", new rows are "A", others stay."""
    keys = new.select(F.col(key).alias("_k")).distinct().withColumn("_new", F.lit(True))
    aged = old.join(keys, F.col(key) == F.col("_k"), "left").withColumn(status, F.when(F.col("_new") & (F.col(status) == "A"), "I").otherwise(F.col(status))).drop("_k", "_new")
    return aged.unionByName(new.withColumn(status, F.lit("A")), allowMissingColumns=True)


# What a valid value looks like, by kind of field.
PATTERNS = {
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}年\d{2}月\d{2}日|\d{4}/\d{2}/\d{2}",
    "gender": r"^(?:男|女|M|F|Male|Female)$",
    "id_number": r"^[0-9A-Z]{10,18}$",
    "phone": r"^1[3-9]\d{9}$",
    "email": r"^[\w.-]+@[\w.-]+\.\w+$",
}
VALIDATED = {"出生日期": "date", "性别": "gender", "证件号码": "id_number", "手机号码": "phone", "电子邮箱": "email", "保险期间开始日期": "date", "保险期间结束日期": "date"}


def valid(value: Column, kind: str) -> Column:
    """Whether a value has the form of its kind; kinds without a form accept all (EXT14)."""
    return value.rlike(PATTERNS[kind]) if kind in PATTERNS else F.lit(True)


def source_confidence(source: Column, is_matched: Column, kv_count: Column) -> Column:
    """How far the way a field was found is trusted (EXT13)."""
    grid = F.when(kv_count >= 3, 0.9).when(kv_count >= 1, 0.8).otherwise(0.6)
    known = F.when(source == "table_header", 1.0).when(source == "content_regex", 0.95).when(source == "grid_fallback", grid).otherwise(0.5)
    return F.when(source.isNull(), 0.5).when(~is_matched, 0.0).otherwise(known)


def field_confidence(source: Column, completeness: Column, quality: Column) -> Column:
    return source * 0.3 + completeness * 0.3 + quality * 0.4


def overall_confidence(fields: DataFrame, expected: int | None) -> DataFrame:
    """(doc_id, overall) of field rows (doc_id, field, confidence): 0.7 mean + 0.3 share of expected fields found."""
    found = F.least(F.count_distinct("field") / F.lit(expected), F.lit(1.0)) if expected else F.lit(1.0)
    return fields.groupBy("doc_id").agg((F.avg("confidence") * 0.7 + found * 0.3).alias("overall"))


def heading_chunks(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk_id, text, markers): text cut before markdown headings, page marks [PAGE:n] taken out (EXT16).

    ``pages`` has doc_id, page, text; the pages of a document are joined in order.
    """
    marked = F.concat(F.lit("[PAGE:"), F.col("page").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    parts = whole.select("doc_id", F.posexplode(F.split("t", r"(?m)(?=^#{1,6} )")).alias("pos", "t"))
    markers = F.transform(F.regexp_extract_all("t", F.lit(r"\[PAGE:(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    text = F.regexp_replace(F.regexp_replace("t", r"\[PAGE:\d+\]\n?", ""), r"^\s+|\s+$", "")
    return parts.select("doc_id", "pos", F.concat_ws("_", "doc_id", "pos").alias("chunk_id"), text.alias("text"), markers.alias("markers"))



"""Benchmark decontamination: a broadcast hash set of normalised test n-grams meets training windows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import map_text
from docweave.llm.words import Words, alphanumeric, covered, per_row, rows_of, scan, starts, windows

#: Words of a window.
WINDOW = 13
#: Characters of test texts whose windows one pass over the documents looks for; more take more passes.
MAX_CHARS = 16_000_000
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bits of the filter that nearly all windows fail before any search.
FILTER_BITS = 22


def _grams(w: Words, i: int, n: int) -> bytes:
    return b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(i, i + n)).lower()


class Tests(NamedTuple):
    """Windows of a block of test items: about 20 bytes each, and the items' normalised words."""

    items: list[str]
    words: bytes  # of all items, parted by single spaces
    by_length: dict[int, tuple[np.ndarray, ...]]  # sorted hashes; item, begin and end in words of each; filter bits


def test_windows(ids: list, texts: list[str | None], window: int = WINDOW) -> Tests:
    """The windows of test items by length; an item of fewer words than ``window`` is one."""
    w = scan(pa.array(texts, pa.large_string()), alphanumeric(), lower=True)
    inside = np.zeros(len(w.data) + 1, np.int64)
    inside[1:] = np.cumsum(alphanumeric()[w.data]) if len(w.data) else 0
    begin = inside[w.start] + np.arange(len(w.start))  # in the words of all items
    end = begin + (w.end - w.start)
    words = b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)).lower()
    parts: dict[int, list] = {}
    for row, item in enumerate(ids):
        first, last = int(w.first[row]), int(w.first[row + 1])
        n = min(window, last - first)
        if not n or item is None:
            continue
        hashes = windows(w.hash[first:last], n)
        parts.setdefault(n, []).append((hashes, np.full(len(hashes), row, np.int32), begin[first : last - n + 1], end[first + n - 1 : last]))
    by_length = {}
    for n, found in parts.items():
        hashes, item, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        by_length[n] = hashes[by], item[by], a[by].astype(np.int32), b[by].astype(np.int32), np.packbits(bits, bitorder="little")
    return Tests([str(x) for x in ids], words, by_length)


def find(texts: pa.Array, tests: Tests) -> list[list]:
    """For each text: its words, the items found, and the merged stretches of hit words."""
    w = scan(texts, alphanumeric(), lower=True)
    rows = len(w.first) - 1
    hit = np.zeros(len(w.hash), bool)
    items: list[set] = [set() for _ in range(rows)]
    row_of = rows_of(w.first)
    for n, (hashes, item, begin, end, bits) in tests.by_length.items():
        all_hashes = windows(w.hash, n)
        place = starts(w.first, n)
        if not len(place):
            continue
        here = all_hashes[place]
        bit = here & np.uint64((1 << FILTER_BITS) - 1)
        maybe = np.flatnonzero(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
        low, high = np.searchsorted(hashes, here[maybe]), np.searchsorted(hashes, here[maybe], side="right")
        sure = []
        for i, a, b in zip(place[maybe].tolist(), low.tolist(), high.tolist(), strict=True):
            if a < b:
                gram = _grams(w, i, n)
                found = {tests.items[item[j]] for j in range(a, b) if tests.words[begin[j] : end[j]] == gram}
                if found:
                    sure.append(i)
                    items[row_of[i]] |= found
        if sure:
            hit |= covered(len(hit), np.array(sure), n)
    begin, end, index = [], [], []
    if hit.any():
        before = np.concatenate([[False], hit[:-1]])
        after = np.concatenate([hit[1:], [False]])
        before[w.first[:-1][w.first[:-1] < len(hit)]] = False
        after[w.first[1:][w.first[1:] > 0] - 1] = False
        begin, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
        index = row_of[begin]
    spans: list[list] = [[] for _ in range(rows)]
    for b, e, r in zip(begin, end, index, strict=True):
        first = int(w.first[r])
        spans[r].append({"at": int(b) - first, "to": int(e) - first})
    return [per_row(np.ones(len(w.hash), np.int64), w.first), [sorted(x) for x in items], spans]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, max_chars: int = MAX_CHARS
) -> DataFrame:
    """Words of each document that lie in any test window, and the items these windows come from.

    The windows' hash set is broadcast in blocks of test items with at most ``max_chars``
    characters (an item of more makes a block of its own); every block passes over all documents.
    Returns the ``keep`` columns (all but the text by default), n_words, n_hit, n_items, items
    (distinct ids as text, sorted), spans (merged hit words, from 0, end exclusive) and
    contaminated (n_hit > 0 and share * n_hit >= n_words). Null or empty texts have no words; an
    item without words or without an id is never found; repeated items count once; an empty
    benchmark leaves every document clean. Extra columns of either table have no part in it.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    tests = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // max_chars))
    tests = tests.withColumn("block", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks)))
    out, names = docs, []
    for block in range(blocks):
        rows = tests.where(F.col("block") == block).collect()  # bounded by max_chars
        held = spark.sparkContext.broadcast(test_windows([r.id for r in rows], [r.text for r in rows], window))
        last = block == blocks - 1
        mine = [f"_n{block}", f"_items{block}", f"_spans{block}"]
        names.append(mine)
        carried = [*keep, *(x for y in names[:-1] for x in y), *([] if last or text in keep else [text])]
        out = map_text(out, text, carried, f"{mine[0]} bigint, {mine[1]} array<string>, {mine[2]} array<struct<at: bigint, to: bigint>>", lambda t, held=held: find(t, held.value))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(x[1]) for x in names]))))
    spans = F.array_sort(F.flatten(F.array(*[F.col(x[2]) for x in names])))
    merged = F.expr("aggregate(_s, cast(array() as array<struct<at: bigint, to: bigint>>), (a, s) -> if(size(a) > 0 and element_at(a, -1).to >= s.at, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).at as at, greatest(element_at(a, -1).to, s.to) as to))), concat(a, array(s))))")
    out = out.select(*[F.col(f"`{c}`") for c in keep], F.col(names[0][0]).alias("_n"), items.alias("_i"), spans.alias("_s"))
    out = out.select(*[F.col(f"`{c}`") for c in keep], "_n", "_i", (F.col("_s") if blocks == 1 else merged).alias("_s"))
    hit = F.expr("aggregate(_s, 0L, (n, s) -> n + s.to - s.at)")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size("_i").cast("long").alias("n_items"), F.col("_i").alias("items"), F.col("_s").alias("spans")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, against the whole benchmark."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

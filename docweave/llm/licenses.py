"""License notices: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits holds at least one of its k + 1 pieces unchanged (pigeonhole). The
pieces are searched as exact seeds; around each seed the regex library's bounded-error matching
verifies the whole notice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import map_text
from docweave.llm.words import Words, alphanumeric, scan

# Fixed values of the contract: phrase and label.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Normalised notices (lower case, words parted by one space), their labels and the edits allowed.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", 6),
    ("released under the mit license", "mit", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 2),
    ("all rights reserved", "all-rights-reserved", 1),
    ("this file is distributed under the bsd license", "bsd", 4),
    ("this source code is subject to the terms of the mozilla public license", "mpl", 6),
]


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice in edits + 1 parts of nearly equal length, each with its place."""
    n, k = len(notice), edits + 1
    at = [n * i // k for i in range(k + 1)]
    return [(at[i], notice[at[i] : at[i + 1]].encode()) for i in range(k)]


def normal_table() -> bytes:
    """Bytes of a text as notices have them: A-Z in lower case, all else than words a space."""
    inside = alphanumeric()
    return bytes((b + 32 if 65 <= b <= 90 else b) if inside[b] else 32 for b in range(256))


def compiled(notices) -> list:
    import regex

    return [(label, len(notice), edits, pieces(notice, edits), regex.compile(b"(?b)(?:" + regex.escape(notice.encode(), special_only=True, literal_spaces=True) + b"){e<=%d}" % edits)) for notice, label, edits in notices]


def fuzzy(norm: bytes, rules: list) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, edits, length of the notice) of the places where a notice stands in a normalised text."""
    found = []
    for label, size, edits, seeds, pattern in rules:
        spans: dict[tuple[int, int], int] = {}
        for offset, seed in seeds:
            at = norm.find(seed)
            while at >= 0:
                left = max(0, at - offset - edits)
                if m := pattern.search(norm, left, min(len(norm), at - offset + size + edits)):
                    spans[m.span()] = sum(m.fuzzy_counts)
                at = norm.find(seed, at + 1)
        found += [(label, a, b, e, size) for (a, b), e in sorted(_apart(spans))]
    return found


def _apart(spans: dict[tuple[int, int], int]) -> list[tuple[tuple[int, int], int]]:
    """Of overlapping places those with the fewest edits, then the first."""
    kept: list[tuple[tuple[int, int], int]] = []
    for (a, b), e in sorted(spans.items(), key=lambda x: (x[1], x[0])):
        if all(b <= x or a >= y for (x, y), _ in kept):
            kept.append(((a, b), e))
    return kept


def places(w: Words, phrase: str) -> np.ndarray:
    """Words where a phrase begins."""
    want = scan(pa.array([phrase]), alphanumeric(), lower=True).hash
    n = len(want)
    if len(w.hash) < n:
        return np.zeros(0, np.int64)
    m = len(w.hash) - n + 1
    at = np.flatnonzero(w.hash[:m] == want[0])
    for i in range(1, n):
        at = at[w.hash[at + i] == want[i]]
    row = np.searchsorted(w.first, at, side="right") - 1
    return at[at + n <= w.first[row + 1]]


def search(texts: pa.Array, rules: list) -> list:
    w = scan(texts, alphanumeric(), lower=True)
    rows = len(w.first) - 1
    n_base, first, last = np.zeros(rows, np.int64), [None] * rows, [None] * rows
    labels: list[set] = [set() for _ in range(rows)]
    for phrase, label in PHRASES.items():
        at = places(w, phrase)
        row = np.searchsorted(w.first, at, side="right") - 1
        for i, r in zip(at.tolist(), row.tolist(), strict=True):
            i -= int(w.first[r])
            n_base[r] += 1
            first[r] = i if first[r] is None else min(i, first[r])
            last[r] = i if last[r] is None else max(i, last[r])
            labels[r].add(label)
    table, notices, score = normal_table(), [], []
    for r, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        norm = b" ".join((text or b"").translate(table).split())
        hits = fuzzy(norm, rules)
        out, best = [], 1.0 if n_base[r] else 0.0
        for label, a, b, e, size in hits:
            out.append({"label": label, "first_word": norm.count(b" ", 0, a), "last_word": norm.count(b" ", 0, max(a, b - 1)), "edits": e})
            best = max(best, 1 - e / size)
        notices.append(out)
        score.append(best)
    base = [sorted(x) for x in labels]
    every = [sorted({*x, *(y["label"] for y in z)}) for x, z in zip(base, notices, strict=True)]
    return [np.diff(w.first), n_base, first, last, base, every, score, notices]


FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, notices array<struct<label: string, first_word: bigint, last_word: bigint, edits: int>>"


def find_licenses(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, notices=NOTICES) -> DataFrame:
    """Exact license phrases and fuzzy notices of each whole text.

    Returns the ``keep`` columns (all but the text by default), n_words, n_base (places of exact
    phrases), first_word and last_word (their smallest and largest start, else null), base_labels,
    labels (with those of fuzzy notices), score (1 with an exact phrase, else the largest share of
    a notice's characters that no edit touches, else 0) and notices (label, first and last word,
    edits; places of one notice do not overlap, fewest edits first). Null and empty texts have no
    words and score 0. Rows are judged each on their own; results replace kept columns of the same
    names.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    held: list = []

    def work(texts: pa.Array) -> list:
        if not held:
            held.append(compiled(notices))
        return search(texts, held[0])

    return map_text(docs, text, keep, FIELDS, work)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    out = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    spans = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x.label, x.first_word, x.last_word, x.edits)), ",")
    return out.withColumns(joined | {"notices": spans})

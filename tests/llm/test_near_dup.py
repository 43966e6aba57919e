"""Near duplicates in made-up corpora with large groups, against brute force."""

from __future__ import annotations

import random

from docweave.llm import near_dup
from tests.llm import brute


def corpus(seed: int, group: int, words: int = 120) -> dict[int, str]:
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(100000)}"
    source = [word() for _ in range(words)]
    docs = [source]
    for _ in range(group):
        copy = list(source)
        for _ in range(r.randrange(0, 12)):
            copy[r.randrange(words)] = word()
        docs.append(copy)
    for d in r.sample(docs, 20):  # copies of copies
        copy = list(d)
        for _ in range(3):
            copy[r.randrange(words)] = word()
        docs.append(copy)
    line = [word() for _ in range(40)]
    docs += [line + [word() for _ in range(r.randrange(1, 30))] for _ in range(60)]
    docs += [["a"] * 3, [], ["a"] * 3, source]
    r.shuffle(docs)
    return {i: " ".join(d) for i, d in enumerate(docs)}


def test_large_groups(spark):
    for seed, group in ((1, 90), (2, 150)):
        docs = corpus(seed, group)
        got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
        assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute.near(docs)


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (5, "A b c d e f", 2), (7, "x", 0), (8, "X", 0)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, N int")).collect()
    assert sorted((r.id or 0, r.n_shingles, r.component_id, r.kept) for r in got) == [(0, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (7, 1, 7, True), (8, 1, 7, False)]
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dup.near_duplicates(none).collect() == []


def test_first_rows_hold_no_python_objects():
    """A batch of sketches is taken apart in arrays, not in lists and dicts of its values."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    sketches = np.sort(r.integers(0, 2**62, (near_dup.ROWS, 64)), axis=1)
    values = np.unique(r.choice(sketches.ravel(), 500))
    lengths = r.integers(33, 500, len(values))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sketches))), pa.array([300] * len(sketches)), pa.array(sketches.tolist())], names=["id", "n", "sketch"])
    tracemalloc.start()
    out = near_dup._first_rows(batch, values, lengths, 64, 75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000  # lists and dicts took 130 MB of a process for ten times as many rows
    held = dict(zip(values.tolist(), lengths.tolist(), strict=True))
    for s, row in zip(sketches.tolist(), out.to_pylist(), strict=True):
        first = sorted(s, key=lambda v: (held.get(v, 0), v))[: 64 - near_dup.need(300, 64, 75) + 1]
        often = [v for v in first if v in held][-near_dup.PIVOTS :]
        assert row["first"] == [{"value": v, "long": False} for v in first if v not in held] + [{"value": v, "long": True} for v in often]
        assert row["common"] == sum(v in held for v in s)


def test_components_of_few_links_write_two_tables(spark, monkeypatch):
    """Few links are labelled on the driver; the rounds in tables give the same."""
    from docweave.llm import graph

    r = random.Random(3)
    chain = [(i, i + 1) for i in range(300, 340)]
    star = [(7, i) for i in range(100, 160)]
    links = [*chain, *star, (5, 5), (9, 8), *((r.randrange(400, 600), r.randrange(400, 600)) for _ in range(150))]
    r.shuffle(links)
    low: dict[int, int] = {i: i for x in links for i in x if x[0] != x[1]}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    table = spark.createDataFrame(links, "a bigint, b bigint")
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    assert {x.id: x.component for x in graph.components(table, spark).collect()} == low
    assert written == ["links", "labels"]
    assert {x.id: x.component for x in graph.components(table, spark, few=0).collect()} == low
    assert len(written) > 4
    assert graph.components(table.limit(0), spark).collect() == []

"""Each query over its whole table against a plain version."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from docweave.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def table(name: str) -> dict:
    return dict(duckdb.sql(f"select * from '{SF}/{name}.parquet' order by 1").project("#1, text").fetchall())


@pytest.fixture(scope="module")
def docs() -> dict:
    return table("documents")


def rows(spark, name: str, *columns: str) -> dict:
    return {r[0]: tuple(r)[1:] for r in queries.QUERIES[name](spark, SF).select("doc_id", *columns).collect()}


def test_secrets(spark, docs):
    got = rows(spark, "op1_secrets", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for d, text in docs.items():
        spans = brute.secrets(text)
        counts = tuple(sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex"))
        assert got[d][:4] == (*counts, brute.sha(brute.spans_text(spans)))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(got[d][4].split(","))


def test_quality(spark, docs):
    got = rows(spark, "op2_quality", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, text in docs.items():
        assert got[d][:6] == brute.quality(text)
        assert not (got[d][5] and got[d][6])


def test_licenses(spark, docs):
    got = rows(spark, "op4_licenses", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for d, text in docs.items():
        assert got[d][:5] == brute.licenses(text)
        assert set(filter(None, got[d][4].split(","))) <= set(got[d][5].split(","))
        assert 0 <= got[d][6] <= 1


def test_decontaminate(spark, docs):
    got = rows(spark, "op5_decontaminate", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.decontaminate(docs, table("benchmark"))
    assert any(x[4] for x in got.values())


def test_near_dup(spark, docs):
    assert rows(spark, "op6_near_dup", "n_shingles", "component_id", "kept") == brute.near(docs)


def test_private(spark, docs):
    got = rows(spark, "op7_private", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for d, text in docs.items():
        spans = brute.private(text)
        counts = tuple(sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone"))
        assert got[d][:5] == (*counts, brute.sha(brute.spans_text(spans)))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(got[d][5].split(","))


def test_phrases(spark, docs):
    assert rows(spark, "op8_phrases", "n_words", "n_removed", "kept_sha256") == brute.repeated(docs)


def test_encode(spark, docs):
    from docweave.llm.forced_bpe import default_vocabulary, load

    t, got = load(default_vocabulary()), rows(spark, "op9_encode", "n_tokens", "ids_sha256", "decoded_sha256")
    for d, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[d] == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False)))


def test_unigram(spark, docs):
    got = rows(spark, "op10_score", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, (held, n, known, total, score) in brute.unigram(docs).items():
        assert got[d][:4] == (held, n, known, total)
        assert got[d][4] == pytest.approx(score, rel=1e-12)
        assert got[d][5] < 0

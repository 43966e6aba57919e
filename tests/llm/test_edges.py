"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import decontam, forced_bpe, interp_lm, licenses, phrases, pii, quality, quotes, secret_scan
from docweave.llm.forced_bpe import default_vocabulary, load
from tests.llm import brute

LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "a", "A b", LONG, LONG, "\x00\x1c x\x85y z", "é" * 300, "token = 'abcdefghijklmnop' " * 3, "CC-BY all rights reserved", "\U0001f600 token: abcdefghijkl1"]
SCHEMA = "doc_id bigint, text string, source string, N_WORDS int, Spans string, kept string, `odd.name` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "s", 1, "x", "y", 2) for i, t in enumerate(TEXTS)]
    rows += [(None, "x y z", None, None, None, None, None), (1, "", "s", None, None, None, None), (3, "a", None, 1, "x", "y", 2), (3, "a", None, 1, "x", "y", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def both(docs, none, run) -> list:
    assert run(none).collect() == []
    out = run(docs).collect()
    assert len(out) == docs.count()
    return out


def test_secrets(docs, none):
    for r in both(docs, none, lambda d: secret_scan.find_secrets(d.select("doc_id", "text", "Spans", "`odd.name`"))):
        assert r.doc_id is None or r.doc_id > 3 or r.spans == []
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans if x.rank < 3] for r in secret_scan.find_secrets(docs, keep=["doc_id"]).collect()}
    assert all(got[i] == brute.secrets(t or "") for i, t in enumerate(TEXTS))


def test_rules_without_trigrams(spark):
    assert secret_scan.clauses("[0-9a-f]+") is None and secret_scan.clauses("a?b?c?") is None
    assert secret_scan.clauses("abc|xyz") == [frozenset({"abc"}), frozenset({"xyz"})]
    assert secret_scan.clauses("ab(c|d)e") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]
    d = spark.createDataFrame([(1, "ff" * 9)], "doc_id int, text string")
    assert len(secret_scan.find_secrets(d, rules=[secret_scan.BASE[2]]).first().spans) == 1


def test_rules_of_two_classes(spark):
    rule = secret_scan.BASE[1]._replace(kind="two", regex="x[a-z]+[0-9]+", least=8)
    d = spark.createDataFrame([(1, "xabcdef1 xab1")], "doc_id int, text string")
    assert [(x.start, x.end) for x in secret_scan.find_secrets(d, rules=[rule]).first().spans] == [(0, 8)]


def test_quality(docs, none):
    got = both(docs, none, quality.apply_rules)
    assert "odd.name" in got[0].__fields__ and got[0].__fields__.count("n_words") == 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(r.text or "")
    shuffled = quality.apply_rules(docs, max_broadcast=0).collect()
    assert sorted(map(repr, shuffled)) == sorted(map(repr, got))


def test_common_lines(spark):
    body = lambda i: " ".join(f"b{i}_{j}" for j in range(60 + i))
    rows = [(i, f"{body(i)}\nShared   line here\nown{i} line", "h") for i in range(30)]
    rows += [(100 + i, "same words of one copied text " * 12 + "\ncopied line", "h") for i in range(40)]
    rows += [(200, "Shared line here\n" * 40 + body(7), "h"), (201, body(8) + "\nShared line here", None)]
    d = spark.createDataFrame(rows, "doc_id int, text string, source string")
    for limit in (0, 1000):
        got = {r.doc_id: r for r in quality.apply_rules(d, max_broadcast=limit).collect()}
        assert got[0].common_lines == [1] and quality.without_lines(got[0].text, [1]) == f"{body(0)}\nown0 line"
        assert got[0].kept and got[100].n_common_words == 0 and got[201].n_common_words == 0
        assert got[200].n_common_words == 120


def test_licenses(docs, none):
    for r in both(docs, none, lambda d: licenses.find_licenses(d, keep=["doc_id", "text"])):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == brute.licenses(r.text or "")


def test_fuzzy_notices(spark):
    texts = ["Released under the MIT License.", "x released  under teh MIT licence y", "released on the limit", "All rigths reserved", "all rights are reserved", "Licensed undr the Apache-Licence, Version 2.0"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(x.label, x.first_word, x.edits) for x in r.notices] for r in licenses.find_licenses(d).collect()}
    assert got[0] == [("mit", 0, 0)] and got[2] == [] and got[4] == []
    assert [x[0] for x in got[5]] == ["apache-2.0"] and got[5][0][2] == 2
    import regex

    for notice, _, edits in licenses.NOTICES:  # every place with few enough edits is found
        rules = [r for r in licenses.compiled(licenses.NOTICES) if r[1] == len(notice)]
        for i in range(0, len(notice) - 3, 3):
            changed = (notice[:i] + "q" + notice[i + 1 :]).encode()
            assert licenses.fuzzy(b"aa " + changed + b" bb", rules)
            assert regex.search(b"(?:" + notice.encode() + b"){e<=%d}" % edits, changed)


def test_decontaminate(spark, docs, none):
    items = [(1, "A b"), (2, None), (None, "a"), (3, ""), (4, " ".join(f"w{i}" for i in range(20))), (4, "x y z"), (5, "a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute.decontaminate(dict(enumerate(TEXTS)), {1: "A b", 4: items[4][1], 5: "a"})
    for chars in (decontam.MAX_CHARS, 40):  # one pass, and several
        got = {r.doc_id: r for r in both(docs, none, lambda d, c=chars: decontam.decontaminate(d, bench, keep=["doc_id", "kept"], max_chars=c))}
        for i in range(4, len(TEXTS)):
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.contaminated) == want[i]
            assert sum(x.to - x["at"] for x in r.spans) == r.n_hit
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.limit(0), keep=["doc_id"]).collect())


def test_private(docs, none):
    for r in both(docs, none, lambda d: pii.find_private(d, keep=["text", "Spans"])):
        assert [(x.kind, x.start, x.end) for x in r.spans if x.kind in pii.KINDS] == brute.private(r.text or "")


def test_base_patterns():
    for text in ("a@b.c x@@y.z foo.bar@m-1.example.com. @a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.04 " + "9" * 5000 + ".1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 1", "+1 (743) 555-3824 ++12 345 +1", "x" * 300 + "@q.w " + "+1 " * 50):
        assert pii.entities(text) == brute.private(text) if "9" * 5000 not in text else len(pii.entities(text)) == 3


def test_revealing_terms(spark):
    filler = lambda i: " ".join(f"z{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26)}" for j in range(20))
    rows = [(i, f"{filler(i)} the secretname writes boss@corp.example.com the {filler(i + 7)}") for i in range(6)]
    rows += [(100 + i, f"{filler(i + 20)} the plain words") for i in range(60)] + [(999, "secretname alone")]
    rows += [(500 + i, "copied context kk ll mm solo@x.example.com nn oo") for i in range(9)]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in pii.find_private(d).collect()}
    spans = {(k, got[0].doc_id, rows[0][1][a:b]) for k, a, b in got[0].spans}
    words = {w for k, _, w in spans if k in ("generalised", "removed")}
    assert "secretname" in words and "the" not in words and "plain" not in words
    assert [x.kind for x in got[999].spans] == ["generalised"] or [x.kind for x in got[999].spans] == ["removed"]
    assert [x.kind for x in got[500].spans] == ["email"]  # copies are one context
    clean = pii.sanitise(rows[0][1], got[0].spans)
    assert "secretname" not in clean and "<EMAIL>" in clean


def test_phrases(docs, none):
    want = brute.repeated(dict(enumerate(TEXTS)))
    got = both(docs, none, lambda d: phrases.drop_repeats(d, keep=["doc_id", "Spans"]))
    for r in got:
        if r.doc_id is not None and r.doc_id > 3:
            assert (r.n_words, r.n_removed, brute.sha(r.kept_text)) == want[r.doc_id]


def test_hot_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 8)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = {i: " ".join(f"o{i}_{j}" for j in range(i % 60)) + f" {passage} " + " ".join(f"e{i}_{j}" for j in range(30)) for i in range(60)}
    texts[60] = " ".join(["same"] * 300)
    texts[61] = " ".join(["same"] * 200 + ["other"] * 60)
    d = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in phrases.drop_repeats(d).collect()}
    assert got == brute.repeated(texts)


def test_encode(docs, none):
    t = load(default_vocabulary())
    for r in both(docs, none, lambda d: forced_bpe.encode(d, keep=["text", "`N_WORDS`".strip("`")], decoded=True)):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_encode_hard_texts(spark):
    t = load(default_vocabulary())
    texts = ["don't 's'x 've!!'re", "a<|endoftext|>b <|ENDOFTEXT|> <|start", "12,3.4e5 x1y2", "é ño é", "你好，世界", "?!~^#@ a_b-c", "İKΣ", "tab\there\r\nnew", " x　y\x85z", "'" * 9 + "ll", "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in forced_bpe.encode(d, decoded=True, keep=["doc_id"]).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, t.decode(ids, skip_special_tokens=False))


def test_score(docs, none, spark):
    rows = both(docs, none, lambda d: interp_lm.score(d.select("doc_id", "text", "kept")))
    assert all(np.isfinite(r.score) and r.score <= 0 and r.n_tokens >= 1 for r in rows)
    only = docs.where("doc_id >= 4 or doc_id in (0, 2)").select("doc_id", "text")
    want = brute.unigram({i: t for i, t in enumerate(TEXTS) if i not in (1, 3)})
    for r in interp_lm.score(only).collect():
        held, n, known, total, base = want[r.id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base)


def test_score_learns(spark):
    r = np.random.default_rng(0)
    word = [f"w{i}" for i in range(50)]
    texts = []
    for i in range(400):
        at, out = 0, []
        for _ in range(60):
            at = (at * 3 + 1) % 50 if r.random() < 0.8 else int(r.integers(50))
            out.append(word[at])
        texts.append((i, " ".join(out)))
    got = interp_lm.score(spark.createDataFrame(texts, "doc_id int, text string")).where("held_out")
    s = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert s.s > 0.8 * s.b  # both negative: the bigram model is much better than unigrams


def test_weights():
    # held-out counts that only the bigram estimate explains give it all weight, and the other way round
    zero = np.zeros(2, np.int64)
    of = np.array([0, 1])
    w = interp_lm.learn_weights(np.array([0, 1]), of, np.array([0.9, 0.0]), np.array([0.1, 0.5]), np.array([0.01, 0.01]), np.array([10, 10]), 2)
    assert w[0, 0] > 0.99 and w[1, 1] > 0.99 and np.allclose(w.sum(1), 1) and len(zero) == 2


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nPlease tell."),
        (1, 1, "assistant", "Under the mat."),
        (1, 2, "user", "Bob wrote:\n> where is  the KEY?\n> please tell.\nI found it."),
        (1, 3, "assistant", "> > Where is the key?\n> I found it.\nGood."),
        (1, 4, "user", "> nobody said this\nok"),
        (1, 5, "user", None),
        (2, 0, "user", "> Under the mat.\nother conversation"),
        (None, 0, "user", "> x\ny"),
    ]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("thread", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(d).collect()}
    assert len(got) == len(rows)
    assert got[1, 2].text == "I found it." and got[1, 2].reply_to == 0 and got[1, 2].thread == 0
    assert got[1, 3].text == "Good." and got[1, 3].reply_to == 2 and got[1, 3].thread == 0
    assert [(x.level, x.original) for x in got[1, 3].quoted] == [(2, 0), (1, 2)]
    assert got[1, 4].text == "ok" and (got[1, 4].n_quotes, got[1, 4].n_linked, got[1, 4].thread) == (1, 0, 4)
    assert got[1, 5].text is None and got[2, 0].reply_to is None and got[None, 0].text == "y"
    assert quotes.link_quotes(d.limit(0)).collect() == []
    assert quotes.link_quotes(d.where("turn < 2 and conv_id = 1")).count() == 2


def test_score_counts_all_bigrams(spark, monkeypatch):
    # 2,100 words equally frequent, half of them always followed by the same word: no word is too rare for its bigrams
    texts = [(i, " ".join(f"u{(i * 7 + j) % 2100} v{(i * 7 + j) % 2100}" for j in range(40))) for i in range(700)]
    texts += [(10_000 + i, " ".join(f"u{(i * 7 + j) % 2100} v{(i * 7 + j + 9) % 2100}" for j in range(40))) for i in range(40)]
    d = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.id: r for r in interp_lm.score(d).collect()}
    usual, odd = ([r.score for r in got.values() if r.held_out and (r.id >= 10_000) == late] for late in (False, True))
    assert len(usual) > 50 and len(odd) > 2 and min(usual) > max(odd) + 20
    model = brute.bigram(dict(texts))
    assert {i: r.score for i, r in got.items()} == pytest.approx(model, rel=1e-9)
    monkeypatch.setattr(interp_lm, "LEAST_RANGES", 3)  # another dealing, the same scores
    monkeypatch.setattr(interp_lm, "BLOCK", 1 << 20)
    assert {r.id: r.score for r in interp_lm.score(d).collect()} == pytest.approx(model, rel=1e-9)


def test_terms_of_unchanged_lines(spark):
    # a contact line with the same words on either side in otherwise different documents; then three documents copied ten times
    words = lambda i, n: " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j)}" for j in range(n))
    line = "regards from sales office north building janedoe jane@corp.example.com call during usual opening hours only please thanks"
    rows = [(i, f"{words(i, 20)} {line} {words(i + 300, 20)}") for i in range(40)]
    rows += [(1000 + 10 * i + c, f"{words(600 + i, 20)} copiedname {words(620 + i, 3)} kim@corp.example.com {words(640 + i, 20)}") for i in range(3) for c in range(10)]
    rows += [(5000 + i, f"{words(i % 200 + 100, 10)} plain text {i}") for i in range(400)]
    rows += [(9000, "janedoe was here"), (9001, "nothing but copiedname")]
    got = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [x.kind for x in got[9000]] in (["generalised"], ["removed"])
    # n(t,e) = n(e) = 3, n(t) = 4 and N = 40 + 3 + 400 + 2 distinct documents: log(N / 4) / log(N / 3) = 0.942
    assert [x.kind for x in got[9001]] == ["generalised"]


def test_common_longest_lines(spark):
    # the shared line is the longest line of its pages; copies of other pages do not raise the bar of their host
    notice = "we use cookies " + " ".join(f"n{j}" for j in range(80))
    rows = [(i, f"{notice}\n" + "\n".join(f"own{i} a{j} b{j + i} c{i}_{j}" for j in range(3)), "h") for i in range(25)]
    rows += [(1000 + i, " ".join(f"copied{j}" for j in range(60)), "h") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id int, text string, source string")
    for limit in (0, 1000):
        got = {r.doc_id: r for r in quality.apply_rules(d, max_broadcast=limit).collect()}
        assert all(got[i].common_lines == [0] and got[i].n_common_words == 83 and not got[i].kept for i in range(25))
        assert got[1000].kept and got[1000].common_lines == []


def test_automaton_locates(monkeypatch):
    """What a shard removes comes from the places that its automaton finds."""
    import ahocorasick
    import pyarrow as pa

    texts = pa.array([" ".join([*(f"{i}_{j}" for j in range(20)), *(f"p{j}" for j in range(70))]) for i in range(3)])
    found = phrases.stretches(texts, np.full(1 << 10, 255, np.uint8), 50, 12)[0]
    rows = [{"row": i, "doc": i, "salts": 1, **x} for i, xs in enumerate(found) for x in xs]
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("salts", pa.int32()), ("h", pa.int64()), ("at", pa.list_(pa.int32())), ("lead", pa.int32()), ("words", pa.string())])
    table = pa.Table.from_pylist(rows, schema)
    got = phrases.locate(table, 50, 12).to_pylist()
    assert {(x["doc"], p) for x in got for p in range(x["at"], x["to"])} == {(d, p) for d in (1, 2) for p in range(20, 90)}

    def empty(_):
        out = ahocorasick.Automaton()
        out.add_word("x", 1)
        out.make_automaton()
        return out

    monkeypatch.setattr(phrases, "automaton_of", empty)
    assert phrases.locate(table, 50, 12).num_rows == 0


def test_quotations_by_brute_force(spark):
    """Generated conversations: whole, rewrapped, shortened and nested quotations, copies, and one hot conversation."""
    import random

    r, messages, rows = random.Random(3), {}, []
    for conv in range(120):
        texts: list[str] = []
        for turn in range(300 if conv == 0 else r.randrange(2, 20)):
            body = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(2, 9))) + r.choice(".?!") for _ in range(r.randrange(1, 6))]
            own = "\n".join(r.choice([" ", "\n", "\n\n"]).join(body[i : i + 2]) for i in range(0, len(body), 2))
            if texts and r.random() < 0.7:
                old = r.choice(texts).split("\n")
                how = r.randrange(3)
                if how == 1:  # wrapped anew
                    words = " ".join(x for x in old if not x.startswith(">")).split()
                    old = [" ".join(words[i : i + 4]).upper() for i in range(0, len(words), 4)]
                elif how == 2:
                    old = old[: r.randrange(1, len(old) + 1)]
                own = "\n".join(["Ann wrote:", *("> " + x for x in old), own])
            texts.append(own)
            messages[conv, turn] = own
            rows.append((conv, turn, "user", own))
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    linked = quotes.link_quotes(d)
    got = {(x.conv_id, x.turn): ([q.original for q in x.quoted], x.reply_to, x.thread) for x in linked.collect()}
    assert got == brute.quotations(messages)
    assert sum(x[1] is not None for x in got.values()) > 500
    for x in quotes.threads(linked).collect():
        seen = set()
        for t in x.turns:
            assert (t.reply_to in seen) if t.reply_to is not None else t.turn == x.thread
            seen.add(t.turn)


def test_size_of_test_windows():
    """Sixteen million characters of benchmark texts take less than 300 MB in a worker."""
    import pickle

    texts = [" ".join(f"t{i}x{j}" for j in range(400)) for i in range(500)]
    size = sum(map(len, texts))
    held = pickle.dumps(decontam.test_windows(list(range(500)), texts))
    assert len(held) * (decontam.MAX_CHARS / size) < 300e6

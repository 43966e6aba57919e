"""Quotation linking: hashes of quoted passages lead to the messages that wrote them first.

A passage is looked for as a whole, among the paragraphs and whole texts of earlier messages, then
by its sentences, then by its lines; the first two do not depend on where lines are broken.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import cut, map_text

MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
#: A line before a quotation that only says whose it is.
ATTRIBUTION = re.compile(r".{0,200}(?:wrote|writes|said|schrieb|a écrit|escribió) ?:\s*$")
#: A passage is linked if at least this share of its sentences, or lines, stands in the original.
MIN_SHARE = 0.5
#: What is hashed, in the order in which links are sought.
WHOLE, SENTENCE, LINE = 0, 1, 2


def words_hash(kind: int, words: list[str]) -> int:
    """A signed 64-bit hash of words with single spaces."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{kind} {' '.join(words)}".encode()) - (1 << 63)


def paragraphs(lines: list[str]) -> list[list[str]]:
    """The words, in lower case, of the stretches between blank lines."""
    out: list[list[str]] = [[]]
    for line in lines:
        words = line.lower().split()
        if words:
            out[-1] += words
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def sentences(words: list[str]) -> list[list[str]]:
    """Words up to one that ends in a full stop, question or exclamation mark; the rest is one too."""
    out: list[list[str]] = [[]]
    for w in words:
        out[-1].append(w)
        if w[-1] in ".!?":
            out.append([])
    return [x for x in out if x]


def hashes(lines: list[str], own: bool) -> list[tuple[int, int]]:
    """(kind, hash) of a passage and its sentences and lines; of a message's own lines, each paragraph too."""
    parts = paragraphs(lines)
    if not parts:
        return []
    out = [(WHOLE, [w for p in parts for w in p])]
    if own:
        out += [(WHOLE, p) for p in parts]
    out += [(SENTENCE, x) for p in parts for x in sentences(p)]
    out += [(LINE, words) for line in lines if (words := line.lower().split())]
    return [(kind, words_hash(kind, words)) for kind, words in out]


def parse(text: str) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """A message's own text, its quotations as (passage, level, kind, hash), and its own hashes.

    A line's level is the number of quotation marks before it; consecutive lines of one level are
    a passage. An attribution goes with the quotation that follows it.
    """
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = MARKS.match(line)
        level = m[0].count(">") if m else 0
        if level:
            if level != before:
                quoted.append((level, []))
                if not before:
                    while own and (not own[-1].strip() or ATTRIBUTION.match(own[-1])):
                        own.pop()
            quoted[-1][1].append(line[m.end() :])
        else:
            own.append(line)
        before = level
    kept = "\n".join(own).strip("\n") if quoted else "\n".join(own)
    found = [(i, level, kind, h) for i, (level, lines) in enumerate(quoted) for kind, h in hashes(lines, False)]
    return kept, found, list(dict.fromkeys(h for _, h in hashes(own, True)))


def _parsed(texts: pa.Array) -> list:
    own, quoted, lines = [], [], []
    for text in texts.to_pylist():
        a, b, c = parse(text or "")
        own.append(None if text is None else a)
        quoted.append([{"passage": p, "level": n, "kind": k, "line": h} for p, n, k, h in b])
        lines.append(c)
    return [own, quoted, lines]


def link_quotes(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Messages without their quotations, linked to what they quote.

    The original of a quoted passage, sentence or line is the first message of the conversation
    that wrote it itself, if it is earlier; a passage not found as a whole goes to the message with most
    of its sentences (the earlier of equal ones), from ``min_share`` of them on, else of its lines. Returns the conversation, turn and role, text (own
    lines only; untouched without quotations), n_quotes (passages), n_linked, quoted (array of
    passage, level and original turn), reply_to (the original of the outermost, then first linked
    passage, else null) and thread (the turn that following reply_to ends at; the message's own
    turn if it replies to none). Ordered by thread and turn, every reply follows its original.
    Null texts stay null; messages without a conversation or turn are linked with nothing; rows
    that repeat a turn count as that turn. Extra columns are left out. A message is
    parsed in one task, whatever its length.
    """
    base = messages.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    parsed = cut(map_text(base, "text", ["conv", "turn", "role"], "own string, quoted array<struct<passage: int, level: int, kind: int, line: bigint>>, lines array<bigint>", _parsed).withColumn("_row", F.monotonically_increasing_id()), "messages")
    quoted = parsed.where("conv is not null and turn is not null").select("_row", "conv", "turn", F.inline("quoted"))
    if not quoted.take(1):
        links = None
    else:
        first = parsed.where("conv is not null and turn is not null").select("conv", "turn", F.explode("lines").alias("line"))
        first = cut(first.groupBy("conv", "line").agg(F.min("turn").alias("original")), "originals")
        votes = quoted.join(first, ["conv", "line"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
        votes = votes.groupBy("_row", "conv", "turn", "passage", "level", "kind", "original").agg(F.count(F.lit(1)).alias("n"))
        best = F.max_by(F.struct("original", "n"), F.when(F.col("original").isNotNull(), F.struct("n", -F.col("original"))))
        passages = votes.groupBy("_row", "conv", "turn", "passage", "level", "kind").agg(F.sum("n").alias("lines"), best.alias("best"))
        original = F.when(F.col("best.n") >= F.col("lines") * min_share, F.col("best.original"))
        passages = passages.withColumn("original", original).groupBy("_row", "conv", "turn", "passage", "level")
        passages = passages.agg(F.min_by("original", F.when(F.col("original").isNotNull(), F.col("kind"))).alias("original"))
        each = F.array_sort(F.collect_list(F.struct("passage", "level", "original")))
        reply = F.min_by("original", F.when(F.col("original").isNotNull(), F.struct("level", "passage")))
        links = cut(passages.groupBy("_row", "conv", "turn").agg(each.alias("quoted_"), reply.alias("reply_to")), "links")
    none = "array<struct<passage: int, level: int, original: bigint>>"
    if links is None:
        out = parsed.withColumns({"quoted_": F.array().cast(none), "reply_to": F.lit(None).cast("bigint"), "thread": F.col("turn")})
    else:
        roots = thread_roots(links.where("reply_to is not null").groupBy("conv", "turn").agg(F.min("reply_to").alias("parent")))
        out = parsed.join(links.drop("conv", "turn"), "_row", "left")
        out = out.join(roots, ["conv", "turn"], "left").withColumn("thread", F.coalesce("root", "turn"))
        out = out.withColumn("quoted_", F.coalesce("quoted_", F.array().cast(none)))
    linked = F.size(F.filter("quoted_", lambda x: x["original"].isNotNull()))
    return out.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("own").alias(text), F.size("quoted_").cast("long").alias("n_quotes"), linked.cast("long").alias("n_linked"), F.col("quoted_").alias("quoted"), "reply_to", "thread")


def thread_roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, root) by pointer doubling: as many rounds as the logarithm of the longest chain."""
    at = cut(parents.select("conv", "turn", F.col("parent").alias("root")), "roots")
    while True:
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        step = cut(at.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if not step.where("moved").take(1):
            return step.select("conv", "turn", "root")
        at = step.select("conv", "turn", "root")


def threads(linked: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """Conversations without quotes: (conversation, thread, turns), a reply after what it replies to.

    ``linked`` are rows of link_quotes() under its default names; turns is an array of turn, role,
    text and reply_to. A thread must fit a task: very long ones are better left as rows, in the
    order of thread and turn.
    """
    each = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "reply_to")))
    return linked.where("turn is not null").groupBy(conversation, "thread").agg(each.alias("turns"))


def op3_quotes(spark, sf_dir: str) -> DataFrame:
    """Every message without quotations, with what it replies to."""
    out = link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("quoted", F.array_join(F.transform("quoted", lambda x: F.concat_ws(":", x["passage"], x["level"], x["original"])), ","))

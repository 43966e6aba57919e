"""Quality rules: counts within a document, and lines that many documents of a host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import cut, map_text, release, rewritten, small
from docweave.llm.words import Words, covered, mix, per_row, rows_of, scan, spaced, starts, windows

MIN_WORDS = 50
#: A text fails if over this percentage of its words stand in 3-word windows found twice or more.
MAX_REPEAT = 50
#: A line is common on a host if at least so many documents have it ...
MIN_DOCUMENTS = 20
#: ... and at least this share of the host's documents.
MIN_SHARE = 0.01
#: A document is depleted if less than this share of its words is left without common lines.
MIN_LEFT = 0.3
#: Salts over which a common line is dealt when its rows are shuffled.
SALTS = 16

SPACE = " \t\n\v\f\r"
SYMBOLS = tuple(b"#*$%&|<>")


def repeats(w: Words, n: int = 3) -> np.ndarray:
    """Words of each row that stand in n-word windows found twice or more in that row."""
    place = starts(w.first, n)
    if not len(place):
        return np.zeros(len(w.first) - 1, np.int64)
    row = rows_of(w.first)[place]
    key = mix(windows(w.hash, n)[place] ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return per_row(covered(len(w.hash), place[twice], n), w.first)


def line_key(words: list[bytes]) -> int:
    """A signed 64-bit hash of a line's words, A-Z in lower case, parted by one space."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - (1 << 63)


def measure(texts: pa.Array, lines_only: bool = False) -> list:
    """For each text: the base counts, then its lines' keys and words, and a key of all its lines."""
    import xxhash

    w = scan(texts, spaced(), lower=False)
    n_words = np.diff(w.first)
    base: list = []
    if not lines_only:
        whole = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        base = [per_row(whole[w.end] - whole[w.start], w.first), None, None, repeats(w)]
    symbols, dups, keys, sizes, marks = [], [], [], [], []
    for text in texts.cast(pa.large_binary()).to_pylist():
        text = text or b""
        seen, k, s, dup = set(), [], [], 0
        for line in text.split(b"\n"):
            words = line.split()
            if not words:
                continue
            dup += line in seen
            seen.add(line)
            k.append(line_key(words))
            s.append(len(words))
        keys.append(k)
        sizes.append(s)
        marks.append(xxhash.xxh3_64_intdigest(np.array(k, np.int64).tobytes()) - (1 << 63))
        if not lines_only:
            symbols.append(sum(map(text.count, SYMBOLS)))
            dups.append(dup)
    if lines_only:
        return [n_words, keys, sizes, marks]
    base[1], base[2] = symbols, dups
    return [n_words, *base, keys, sizes, marks]


COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def common_lines(docs: DataFrame, *, text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line): keys of the lines that too many distinct documents of a host have.

    Documents whose lines are the same, but for case and white space, are one document, of a line
    and of its host alike. A null host is a host of its own.
    """
    rows = map_text(docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")), "text", ["host"], "_n bigint, _keys array<bigint>, _sizes array<bigint>, _mark bigint", lambda t: measure(t, lines_only=True))
    every = F.array(F.lit(None).cast("bigint"))  # a null line stands in every document: its count is the host's
    rows = rows.select("host", F.explode(F.concat(F.array_distinct("_keys"), every)).alias("line"), "_mark")
    counted = rows.groupBy("host", "line", "_mark").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("one").alias("n"))
    counted = cut(counted.where(F.col("line").isNull() | (F.col("n") >= min_documents)), "counted")
    hosts = counted.where("line is null").select(F.col("host").alias("h"), F.col("n").alias("documents"))
    counted = counted.where("line is not null")
    return counted.join(hosts, counted.host.eqNullSafe(hosts.h)).where(F.col("n") >= F.col("documents") * min_share).select("host", "line")


def apply_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    keep: list[str] | None = None,
    min_documents: int = MIN_DOCUMENTS,
    min_share: float = MIN_SHARE,
    min_left: float = MIN_LEFT,
    max_broadcast: int = 200_000,
    rewrite: bool = False,
) -> DataFrame:
    """Base counts of each document, its words outside common lines, and the verdict.

    Returns the ``keep`` columns (all by default), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_common_words (words in common lines), common_lines (their
    positions among the lines with a word, from 0) and kept: not base_failed, and words outside
    common lines are at least ``min_left`` of all. Null and empty texts have no words and fail.
    With ``rewrite``, the text among the ``keep`` columns is without its common lines.
    Repeated rows are judged each on its own and count once among the documents of a line and of a host.
    Results replace input columns of the same names.
    """
    keep = list(docs.columns) if keep is None else keep
    rewrite = rewrite and text in keep
    common = cut(common_lines(docs, text=text, host=host, min_documents=min_documents, min_share=min_share), "lines")
    if small(common, max_broadcast):
        found = {}
        for r in common.collect():  # bounded by max_broadcast
            found.setdefault(r.host, set()).add(r.line)
        release(common)
        held = docs.sparkSession.sparkContext.broadcast(found)

        def marked(texts, hosts):
            *base, keys, sizes, _ = measure(texts)
            hit = [[i for i, k in enumerate(ks) if k in held.value.get(h, ())] for h, ks in zip(hosts.to_pylist(), keys, strict=True)]
            lost = [sum(n[i] for i in at) for n, at in zip(sizes, hit, strict=True)]
            new = [list(map(without_lines, texts.to_pylist(), hit))] if rewrite else []
            return [*base, lost, hit, *new]

        # one pass: Spark starts a Python worker a task for each mapInArrow of a stage, and keeps them
        rows = map_text(docs, text, keep, f"{COUNTS}, n_common_words bigint, common_lines array<int>" + f", `{text}` string" * rewrite, marked, also=(host,))
    else:
        lines_of = f"{COUNTS}, _keys array<bigint>, _sizes array<bigint>, _mark bigint"
        rows = cut(map_text(docs.withColumns({"_host": F.col(f"`{host}`")}), text, [*keep, "_host"], lines_of, measure).withColumn("_row", F.monotonically_increasing_id()), "docs")
        lines = rows.select("_row", F.col("_host").alias("host"), F.posexplode("_keys").alias("pos", "line"))
        lines = lines.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
        dealt = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"host": "h", "line": "l", "salt": "s"})
        hits = lines.join(dealt, (lines.line == dealt.l) & (lines.salt == dealt.s) & lines.host.eqNullSafe(dealt.h), "left_semi")
        hits = hits.groupBy("_row").agg(F.array_sort(F.collect_list("pos")).alias("_hit"))
        rows = rows.join(hits, "_row", "left").withColumn("_hit", F.coalesce("_hit", F.array().cast("array<int>")))
        lost = F.expr("aggregate(_hit, 0L, (n, i) -> n + _sizes[i])")
        rows = rows.withColumns({"n_common_words": lost, "common_lines": F.col("_hit")})
        if rewrite:
            rows = rewritten(rows.drop("_keys", "_sizes", "_mark", "_hit"), text, without_lines, "common_lines")
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    rows = rows.withColumn("base_failed", base_failed)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= F.col("n_words") * min_left))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "common_lines", "kept"]
    return rows.select(*[F.col(f"`{c}`") for c in keep if c.lower() not in made], *made)


def without_lines(text: str | None, positions: list[int]) -> str | None:
    """The text without those of its lines with a word that stand at the given positions."""
    if text is None or not positions:
        return text
    gone, i, left = set(positions), 0, []
    for line in text.split("\n"):
        if line.strip(SPACE):
            if i not in gone:
                left.append(line)
            i += 1
        else:
            left.append(line)
    return "\n".join(left)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")

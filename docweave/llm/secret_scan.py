"""Secret scans: a trigram inverted index picks candidates for each rule, which its regex verifies.

Only DataFrame functions run on executors. Each rule's regex is read on the driver into a Boolean
query over trigrams that every match must hold. Postings list, for each trigram that some query
names, the rows whose lower-cased text has it; intersecting them gives a rule's candidates. A
rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import cut, sized


class Rule(NamedTuple):
    kind: str
    regex: str  # the same for Python, which reads it, and Java, which runs it
    group: int = 0  # this group must have at least ``least`` characters
    least: int = 0
    any_case: bool = False


# Fixed values of the contract: the first three rules.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
]
RULES = [
    *BASE,
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]
#: Strings that a part of a regex may stand for before it counts as unknown.
MAX_STRINGS = 24


def clauses(regex: str) -> list[frozenset[str]] | None:
    """The trigram query of a regex: any of these sets, whole; None if no trigram is mandatory.

    Walks the parsed regex and keeps the set of strings that the part read so far can end in;
    where the set grows too large or a part is open, the strings read so far become a condition.
    Letters count in lower case.
    """
    from re import _parser as parser

    conditions: list[set[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets):  # a string under three letters leaves nothing to ask for
            conditions.append(sets)

    def strings_of(items) -> set[str] | None:
        """All strings of a part, or None."""
        found = {""}
        for op, value in items:
            one = options(str(op), value)
            if one is None:
                return None
            found = {a + b for a in found for b in one}
            if len(found) > MAX_STRINGS:
                return None
        return found

    def options(op: str, value) -> set[str] | None:
        if op == "LITERAL":
            return {chr(value).lower()}
        if op == "SUBPATTERN":
            return strings_of(value[3])
        if op == "BRANCH":
            parts = [strings_of(x) for x in value[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 3:
            one = strings_of(value[2])
            if one is not None:
                found, last = set(), {""}
                for n in range(value[1] + 1):
                    found |= last if n >= value[0] else set()
                    last = {a + b for a in last for b in one}
                return found if len(found) <= MAX_STRINGS else None
        if op == "IN" and len(value) <= 6 and all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}
        return None

    read: set[str] = {""}
    for op, value in parser.parse(regex):
        one = options(str(op), value)
        more = None if one is None else {a + b for a in read for b in one}
        if more is not None and len(more) <= MAX_STRINGS:
            read = more
            continue
        flush(read)
        read = one if one is not None else {""}
    flush(read)
    if not conditions:
        return None
    query = {frozenset()}
    for sets in conditions:
        query = {a | b for a in query for b in sets}
        if len(query) > 4 * MAX_STRINGS:
            query = conditions[0]
            break
    return sorted((a for a in query if not any(b < a for b in query)), key=sorted)


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.any_case else "") + rule.regex


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """(start, rank, end, kind) of a rule's matches, in code points: what lies between the matches gives their places."""
    pattern = F.lit(_java(rule))
    whole, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, _java(rule), -1)
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.slice(parts, 1, F.size(whole)).alias("p"), whole.alias("w"), tested.alias("t"))
    kind = F.lit(rule.kind)
    empty = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))

    def add(acc, row):
        begin = acc["at"] + F.length(row["p"])
        end = begin + F.length(row["w"])
        one = F.array(F.struct(begin.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), kind.alias("kind")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(row["t"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rows, start, add, lambda acc: acc["found"])


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, row): which rows' lower-cased texts hold each trigram."""
    low = rows.select("_row", F.lower("_text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("_row", F.explode(held).alias("trigram"))


def candidates(rows: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """(row, rules): a bit for each rule whose trigram query the row's postings meet."""
    asked = [(i, clause) for i, r in enumerate(rules) for clause in clauses(r.regex) or []]
    if not asked:
        return None
    trigrams = sorted({t for _, clause in asked for t in clause})
    values = ", ".join(f"({trigrams.index(t)}, {c}, {i}, {1 << n}L, {(1 << len(clause)) - 1}L)" for c, (i, clause) in enumerate(asked) for n, t in enumerate(sorted(clause)))
    terms = rows.sparkSession.sql(f"select * from values {values} as q(trigram, clause, rule, bit, full)")
    met = postings(rows, trigrams).join(F.broadcast(terms), "trigram")  # one row for each trigram of a query
    met = met.groupBy("_row", "clause", "rule", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
    return met.groupBy("_row").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("_rules"))


def find_secrets(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns the ``keep`` columns (all but the text by default) and spans, an array of (start,
    rank, end, kind) by start and then by the rules' order; matches of one rule do not overlap,
    and those of too few characters are dropped without another try. Null and empty texts have
    none. Rows are named by a hash of their kept columns and text: equal rows share postings, and
    a collision only lets a regex look in vain. Candidates are broadcast if counted to be few,
    else rows and candidates are shuffled by that hash. A kept column named spans gives way.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c.lower() != "spans"]
    ids = [F.col(f"`{c}`") for c in keep]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*[c.alias(f"_{i}") for i, c in enumerate(ids)], value.alias("_text"))
    rows = rows.withColumn("_row", F.xxhash64(*[F.col(f"_{i}").cast("string") for i in range(len(ids))], "_text"))
    found = candidates(rows, rules)
    if found is not None:
        rows = rows.join(sized(cut(found, "candidates")), "_row", "left")
    else:
        rows = rows.withColumn("_rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    parts = []
    for i, rule in enumerate(rules):
        asked = F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0 if clauses(rule.regex) else F.lit(True)
        if not rule.group and rule.least and re.fullmatch(r"[A-Za-z0-9_ -]*\[[^\[\]]+\]\+", rule.regex):
            # the match runs on to the last character of its class: shorter runs need no look
            rule = rule._replace(regex=f"{rule.regex[:-1]}{{{rule.least - len(rule.regex.partition('[')[0])},}}")
        there = F.col("_text").rlike(_java(rule))
        parts.append(F.when(asked & there, spans_of(F.col("_text"), rule, i)).otherwise(none))
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.array_sort(F.concat(*parts)).alias("spans"))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda x: x["rank"] < len(kinds))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = {f"n_{k}": F.expr(f"cast(size(filter(spans, x -> x.rank = {i})) as bigint)") for i, k in enumerate(kinds)}
    return out.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))

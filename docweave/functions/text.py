"""Text, date, hash and JSON functions (STR1-12, DAT1, HSH1, JSN1, TOK1, GRF2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats that are read, after 年 月 日 became dashes.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")


def to_date(c: Column) -> Column:
    """A date in one of the known formats, else null (DAT1)."""
    text = F.trim(F.regexp_replace(F.regexp_replace(c, "[年月]", "-"), "日", ""))
    return F.coalesce(*[F.try_to_timestamp(F.when(F.length(text) > 0, text), F.lit(f)).cast("date") for f in DATE_FORMATS])


def to_decimal(c: Column) -> Column:
    """A decimal(15,2) without commas and blanks, else null."""
    return F.regexp_replace(c, "[, ]", "").try_cast("decimal(15,2)")


def to_float(c: Column) -> Column:
    return F.regexp_replace(c, "[, ]", "").try_cast("double")


def to_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


CONVERTERS = {"date": to_date, "decimal": to_decimal, "float": to_float, "string": to_text}


def converted(c: Column, kind: str) -> Column:
    """A value as a kind of field; unknown kinds are text, empty values null (EXT12)."""
    return CONVERTERS.get(kind, to_text)(F.nullif(c, F.lit("")))


def sanitised_name(c: Column, most: int = 255) -> Column:
    """A file name without unsafe characters, cut to a length that keeps its extension (STR4)."""
    name = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(stem, F.lit(1), F.lit(most) - F.length(ext)), ext))


def is_float(c: Column) -> Column:
    """Whether a text is a number with an optional fraction (STR5)."""
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def cleaned(c: Column) -> Column:
    """Without HTML entities of the common kinds, surrounding blanks, quotes and control characters (STR3)."""
    out = c
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.trim(out), r'["\x00-\x1f\x7f-\x9f]', "")


def cleaned_reply(c: Column) -> Column:
    """A model's reply without its thoughts, code fences, quotes and prefix (STR6)."""
    out = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"```[a-zA-Z]*", "")
    out = F.regexp_replace(out, r"^\s*(?:输出|Output)\s*[:：]\s*", "")
    return F.trim(F.regexp_replace(out, "^[\"'“”\\s]+|[\"'“”\\s]+$", ""))


def reply_lines(c: Column) -> Column:
    """The lines of a reply that are not empty once cleaned (STR7)."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), "\n"), cleaned_reply), lambda x: x != "")


def json_of(c: Column) -> Column:
    """The first balanced JSON object in noisy text, without comments; "{}" if there is none (STR8)."""
    def scan(text: str | None) -> str:
        import json
        import re

        text = re.sub(r"```[a-zA-Z]*", "", text or "")
        start = text.find("{")
        while start >= 0:
            depth, quoted, skip = 0, False, False
            for i in range(start, len(text)):
                ch = text[i]
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = ch == "\\", ch != '"'
                elif ch == '"':
                    quoted = True
                elif ch in "{}":
                    depth += 1 if ch == "{" else -1
                    if not depth:
                        body = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text[start : i + 1], flags=re.S)
                        try:
                            return json.dumps(json.loads(body), ensure_ascii=False)
                        except ValueError:
                            break
            start = text.find("{", start + 1)
        return "{}"

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(scan)

    return run(c)


def id_list(c: Column, name: str = "relevant_clause_ids") -> Column:
    """Numbers of a list that a reply names (STR9)."""
    inside = F.regexp_extract(c, name + r'"?\s*:\s*\[([^\]]*)\]', 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))


def rewrite_of(reply: Column, query: Column) -> Column:
    """(query, intent) of a rewrite reply; any intent but logic is fact, no query keeps the old one (STR10)."""
    told = F.from_json(reply, "query string, intent string")
    return F.struct(F.coalesce(F.nullif(F.trim(told["query"]), F.lit("")), query).alias("query"), F.when(told["intent"] == "logic", "logic").otherwise("fact").alias("intent"))


def filled(template: str, **values: Column) -> Column:
    """A template with {{ name }} places (STR11)."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.regexp_replace(out, r"\{\{\s*" + name + r"\s*\}\}", "\u0001")
        out = F.replace(out, F.lit("\u0001"), value.cast("string"))
    return out


def repaired_json(c: Column) -> Column:
    """JSON with its bare numeric keys quoted (STR12)."""
    return F.regexp_replace(c, r"([{,]\s*)(\d+)\s*:", r'$1"$2":')


def tokens_estimate(c: Column) -> Column:
    """A quarter of the characters (TOK1)."""
    return F.floor(F.length(c) / 4)


def hashed_id(*parts: Column) -> Column:
    """The first 60 bits of the SHA-256 of the parts joined by colons; null if a part is."""
    some = parts[0].isNotNull()
    for p in parts[1:]:
        some = some & p.isNotNull()
    return F.when(some, F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("bigint"))


def args_key(prefix: str, *args: Column) -> Column:
    """A cache key: prefix and MD5 of the arguments joined by bars."""
    return F.concat(F.lit(f"{prefix}:"), F.md5(F.concat_ws("|", *args)))


def content_id(content: Column, kb: Column) -> Column:
    """xxh64 (seed 0) of content and base, as hex."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda x: None if x is None else xxhash.xxh64_hexdigest(x.encode()))

    return run(F.concat(content, kb))

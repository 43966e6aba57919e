"""Personal data: patterns find entities; corpus co-occurrence finds the terms that give them away.

A term t discloses an entity e by PMI(t; e) / IC(e), that is log(n(t,e) N / (n(t) n(e))) over
log(N / n(e)): 1 where every document with the term has the entity near it, 0 where the two are
independent. Terms whose disclosure exceeds a threshold are generalised, or beyond a second one
removed, wherever they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import chunks, cut, map_text, release, rewritten, sized
from docweave.llm.words import rows_of, scan

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that count as near it.
NEAR = 8
#: Bytes of the shortest term.
MIN_BYTES = 3
#: Distinct documents in which a term must stand near an entity.
MIN_SUPPORT = 3
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Terms that one pass over the documents looks for; more take more passes.
MAX_TERMS = 1_000_000

# What the base kinds look like. Lookbehinds only spare starts that must fail.
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits' check sum holds."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        if at < done:
            at = text.find("@", done)
            continue
        # the local part is the longest run of its characters before the sign, after the last match
        start = at
        while start > done:
            part = text[max(done, start - 64) : start]
            left = len(part.rstrip(EMAIL_LOCAL))
            start -= len(part) - left
            if left:
                break
        if start < at and (m := EMAIL_REST.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start; leftmost, without overlap in a kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(d) <= 3 and int(d or 0) <= 255 for d in (p.lstrip("0") for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


def contexts(texts: pa.Array, documents: pa.Array) -> list:
    """For each text: (entity, term, document), and once for each entity a row without a term."""
    import xxhash

    out: list[list] = []
    for text, document in zip(texts.to_pylist(), documents.to_pylist(), strict=True):
        rows: list = []
        found = entities(text or "")
        if found:
            w = scan(pa.array([text], pa.large_string()), _letters(), lower=True)
            spans = [(kind, len(text[:a].encode()), len(text[:b].encode()), text[a:b]) for kind, a, b in found]
            usable = w.end - w.start >= MIN_BYTES
            for _, a, b, _ in spans:
                usable &= (w.end <= a) | (w.start >= b)
            start, end, hashed = w.start[usable], w.end[usable], w.hash[usable]
            near: dict[int, list] = {}
            for kind, a, b, value in spans:
                key = xxhash.xxh3_64_intdigest(f"{kind}:{value.lower()}".encode()) - (1 << 63)
                i, j = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(start, b))
                near.setdefault(key, []).append(hashed[max(0, i - NEAR) : i])
                near[key].append(hashed[j : j + NEAR])
            for key, parts in near.items():
                terms = np.unique(np.concatenate(parts))
                rows += [{"entity": key, "term": t, "document": document} for t in [None, *_signed(terms)]]
        out.append(rows)
    return [out]


def _among(hashes: np.ndarray, wanted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of hashes that are among the sorted wanted ones; bits is wanted's filter."""
    maybe = np.flatnonzero(bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, hashes[maybe]), len(wanted) - 1)
    return maybe[wanted[at] == hashes[maybe]]


def filter_of(wanted: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 24, bool)
    bits[(wanted & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return bits


def _blocks(terms: DataFrame, columns: list[str]):
    """The rows of a table of terms, in blocks of about MAX_TERMS, as sorted arrays."""
    n = terms.count()
    blocks = -(-n // MAX_TERMS)
    for i in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).collect()  # about MAX_TERMS rows
        if rows:
            key = np.array([r.term for r in rows], np.int64).view(np.uint64)
            order = np.argsort(key)
            yield key[order], *(np.array([r[c] for r in rows])[order] for c in columns)


def revealing_terms(docs: DataFrame, *, text: str = "text", min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, removed): hashes of the terms whose disclosure of some entity exceeds a threshold.

    A term must stand near the entity in ``min_support`` documents. All counts are of distinct
    texts: n(t,e) with the term near the entity, n(t) with the term, n(e) with the entity, N all;
    copies of one document are one.
    """
    spark = docs.sparkSession
    one = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("document", F.xxhash64("text"))
    copies = cut(one.groupBy("document").agg(F.count(F.lit(1)).alias("copies")), "copies")
    rows = map_text(one, "text", [], "c array<struct<entity: bigint, term: bigint, document: bigint>>", contexts, also=("document",)).select(F.inline("c"))
    rows = cut(rows.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")), "contexts")
    pairs = rows.where(F.col("term").isNotNull() & (F.col("both") >= min_support))
    alone = rows.where("term is null").select("entity", F.col("both").alias("n_entity"))
    pairs = cut(pairs.join(alone, "entity"), "pairs")
    # each of n copies of a text counts as a share of 1 / n
    several = sized(copies.where("copies > 1"))
    weighed = one.join(several, "document", "left").select("text", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("share"))
    parts = []
    for (wanted,) in _blocks(pairs.select("term").distinct(), []):
        held = spark.sparkContext.broadcast((wanted, filter_of(wanted)))

        def counted(batches, held=held):
            wanted, bits = held.value
            n = np.zeros(len(wanted))  # documents of this partition with each term
            for batch in batches:
                for part in chunks(batch, 0):
                    w = scan(part.column(0), _letters(), lower=True)
                    at = _among(w.hash, wanted, bits)
                    once = np.unique(rows_of(w.first)[at] * len(wanted) + np.searchsorted(wanted, w.hash[at]))
                    n += np.bincount(once % len(wanted), part.column(1).to_numpy()[once // len(wanted)], minlength=len(wanted))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(n[some])], names=["term", "n"])

        parts.append(weighed.mapInArrow(counted, "term bigint, n double").groupBy("term").agg(F.round(F.sum("n")).alias("n_term")))
    if not parts:
        return spark.createDataFrame([], "term bigint, removed boolean")
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    total = float(copies.count())
    told = F.try_divide(F.log(F.col("both") * total / (F.col("n_term") * F.col("n_entity"))), F.log(F.lit(total) / F.col("n_entity")))
    out = pairs.join(counts, "term").groupBy("term").agg(F.max(told).alias("told")).where(F.col("told") >= generalise)
    return out.select("term", (F.col("told") >= remove).alias("removed"))


def spans_of(texts: pa.Array, sets: list) -> list:
    """For each text: base spans, then spans of revealing terms outside them."""
    out = [[{"kind": k, "start": a, "end": b} for k, a, b in entities(t or "")] for t in texts.to_pylist()]
    if sets:
        w = scan(texts, _letters(), lower=True)
        row_of = rows_of(w.first)
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        more: dict[int, list] = {}
        for wanted, removed, bits in sets:
            for i in _among(w.hash, wanted, bits).tolist():
                r = int(row_of[i])
                begin = chars[w.row_at[r]]
                a, b = int(chars[w.start[i]] - begin), int(chars[w.end[i]] - begin)
                if all(b <= x["start"] or a >= x["end"] for x in out[r]):
                    kind = "removed" if removed[np.searchsorted(wanted, w.hash[i])] else "generalised"
                    more.setdefault(r, []).append({"kind": kind, "start": a, "end": b})
        for r, found in more.items():
            out[r] += sorted(found, key=lambda x: (x["kind"], x["start"]))
    return [out]


def find_private(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, rewrite: bool = False) -> DataFrame:
    """Spans of personal data and of the terms that disclose it, in every whole text.

    Returns the ``keep`` columns (all but the text by default) and spans, an array of (kind,
    start, end) in code points, end exclusive: email, ip, card, phone, generalised, removed, each
    by start. Null and empty texts have none. Terms are looked for in blocks of MAX_TERMS, one
    pass each. Repeated texts count once; extra columns have no part. With ``rewrite``, the text
    among the ``keep`` columns is the sanitised one.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rewrite = rewrite and text in keep
    told = cut(revealing_terms(docs, text=text, min_support=min_support, generalise=generalise, remove=remove), "terms")
    spark, sets = docs.sparkSession, list(_blocks(told, ["removed"]))
    release(told)
    fields = "spans array<struct<kind: string, start: bigint, end: bigint>>"
    held = spark.sparkContext.broadcast([(w, r, filter_of(w)) for w, r in sets[:1]])
    carried = [text] if len(sets) > 1 and text not in keep else []
    if rewrite and len(sets) < 2:  # in the same pass: a second one would start as many Python workers again

        def both(texts):
            found = spans_of(texts, held.value)
            return [*found, list(map(sanitise, texts.to_pylist(), *found))]

        return map_text(docs, text, keep, f"{fields}, `{text}` string", both).select(*[F.col(f"`{c}`") for c in keep if c.lower() != "spans"], "spans")
    out = map_text(docs, text, [*keep, *carried], fields, lambda t: spans_of(t, held.value))
    for i, (w, r) in enumerate(sets[1:], 2):
        more = spark.sparkContext.broadcast([(w, r, filter_of(w))])
        out = map_text(out.withColumnRenamed("spans", "_s"), text, [*keep, "_s", *(carried if i < len(sets) else [])], fields, lambda t, more=more: spans_of(t, more.value))
        told = lambda c: F.filter(c, lambda x: x["kind"].isin("generalised", "removed"))
        base = F.filter("_s", lambda x: x["kind"].isin(*KINDS))
        out = out.withColumn("spans", F.concat(base, F.array_sort(F.concat(told("_s"), told("spans"))))).drop("_s")
    return rewritten(out, text, sanitise, "spans") if rewrite else out


def sanitise(text: str | None, spans: list) -> str | None:
    """The text with entities and generalised terms replaced by their kind, and removed terms gone."""
    if not text or not spans:
        return text
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if x["start"] < at:
            at = max(at, x["end"])  # an overlapping span of another kind goes as well
            continue
        out += [text[at : x["start"]], "" if x["kind"] == "removed" else "<TERM>" if x["kind"] == "generalised" else f"<{x['kind'].upper()}>"]
        at = x["end"]
    return "".join([*out, text[at:]])


def op7_private(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    out = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    counts = {f"n_{k}": F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)") for k in KINDS}
    return out.withColumns(counts | {"base_sha256": F.sha2(shown(base), 256), "spans": shown(F.col("spans"))})

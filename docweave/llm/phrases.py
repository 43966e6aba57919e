"""Repeated passages: recurring phrases are confirmed, compiled into sharded Aho-Corasick automata and located.

Every window of 50 words names one phrase of 12 words in it, the one with the smallest hash. Equal
windows name equal phrases, so a window can only recur if its phrase does. Phrases of more than one
document are counted by their hashes; a bit table of fixed size tells which stretches of the
documents can hold one. All documents are streamed through it, and these stretches, in shards by
phrase, through the automaton of the shard's phrases: words are its letters. The windows around the
places that it finds are compared, by two 64-bit hashes, in the order of doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import cut, map_text, release, sized, whole_id
from docweave.llm.words import covered, distinct, gather, mix, scan, spaced, starts, windows

#: Words of a window that must not repeat, and of the phrase that it names.
WINDOW, PHRASE = 50, 12
#: Stretches that one automaton is given, about; those of phrases with more are dealt over salts.
SHARD = 4000
#: Bits, as a power of two, of the table of recurring phrases (16 MB). Once it is crowded, more
#: stretches than needed are sent to the automata, which find nothing in them.
BITS = 27
#: Bounds of stretches whose lists by document may be broadcast (8 bytes each at most).
MAX_LISTED = 1_000_000


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def least_hashes(texts: pa.Array, window: int, phrase: int):
    """The scan, its phrases' hashes, window starts, and for each window the hash of its phrase."""
    w = scan(texts, spaced(), lower=False)
    at = starts(w.first, window)
    grams = windows(w.hash, phrase)
    least = sliding_min(grams, window - phrase + 1)[at] if len(at) else np.zeros(0, np.uint64)
    return w, grams, at, least


def phrase_hashes(texts: pa.Array, window: int, phrase: int) -> list:
    """For each text, the distinct hashes of the phrases that its windows name."""
    w, _, at, least = least_hashes(texts, window, phrase)
    begin = np.searchsorted(at, w.first)
    return [[distinct(least[a:b]).view(np.int64) for a, b in zip(begin[:-1], begin[1:], strict=True)]]


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits, of which those of the hashes are set."""
    x = F.expr(f"h & {(1 << bits) - 1}L")
    parts = hashes.groupBy((x / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod(x, F.lit(32768))).alias("map"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.toLocalIterator():  # 2**(bits - 15) rows of 4 KB at most
        out[r.part * 4096 : r.part * 4096 + len(r.map)] = np.frombuffer(r.map, np.uint8)
    return out


def stretches(texts: pa.Array, table: np.ndarray, window: int, phrase: int) -> list:
    """For each text, its stretches whose windows name a phrase that the table may hold.

    A stretch is (hash, the starts of its first window, the phrase's word in it, the words of all
    its windows parted by spaces); what a text repeats is one stretch with several starts.
    """
    w, grams, at, least = least_hashes(texts, window, phrase)
    out: list[list] = [[] for _ in range(len(w.first) - 1)]
    bit = least & np.uint64(len(table) * 8 - 1)
    maybe = np.flatnonzero(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
    if not len(maybe):
        return [out]
    place, here = np.full(len(maybe), -1), at[maybe]
    for j in range(window - phrase + 1):  # the first of equal hashes
        now = (place < 0) & (grams[here + j] == least[maybe])
        place[now] = here[now] + j
    # windows that name one place follow each other
    edge = np.flatnonzero((np.diff(place) != 0) | (np.diff(here) != 1)) + 1
    first, last = np.append(0, edge), np.append(edge, len(maybe)) - 1
    row = np.searchsorted(w.first, here[first], side="right") - 1
    raw, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
    found: dict = {}
    for r, s, e, p, h in zip(row.tolist(), here[first].tolist(), (here[last] + window).tolist(), place[first].tolist(), least[maybe[first]].view(np.int64).tolist(), strict=True):
        words = b" ".join([raw[x:y] for x, y in zip(start[s:e], end[s:e], strict=True)])
        found.setdefault((r, h, p - s, words), []).append(s - int(w.first[r]))
    for (r, h, lead, words), begin in found.items():
        out[r].append({"h": h, "at": begin, "lead": lead, "words": words.decode()})
    return [out]


def automaton_of(phrases: list[str]):
    """The Aho-Corasick automaton of phrases whose letters stand for words."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in phrases:
        out.add_word(p, len(p))
    out.make_automaton()
    return out


def letters(hashes: np.ndarray) -> str:
    """A letter for each word, by 20 bits of its hash."""
    return (0x10000 + (hashes & np.uint64(0xFFFFF)).astype("<u4")).astype("<u4").tobytes().decode("utf-32-le")


def later(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows, by their two hashes, also stand in a document of smaller id."""
    by = np.lexsort((doc, k2, k1))
    new = np.ones(len(by), bool)
    new[1:] = (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])
    owner = doc[by][np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else doc
    out = np.zeros(len(by), bool)
    out[by] = doc[by] > owner
    return out


def runs(row: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """Windows at sorted places of rows as merged runs: row, doc, first word, one past the last word."""
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return [row[first], doc[first], at[first], at[last] + window]


FOUND = "row bigint, doc bigint, at bigint, to bigint, bucket bigint, k1 array<bigint>, k2 array<bigint>, docs array<bigint>, rows array<bigint>, starts array<bigint>"


def _found(hits: list[np.ndarray], buckets: dict[int, list[np.ndarray]]) -> pa.Table:
    number, numbers = pa.int64(), pa.list_(pa.int64())
    shape = pa.schema([(x.split()[0], numbers if x.endswith(">") else number) for x in FOUND.split(", ")])
    none = lambda n, f: pa.nulls(n, f.type)
    n = len(hits[0])
    a = pa.table([*(pa.array(x, pa.int64()) for x in hits), *(none(n, f) for f in list(shape)[4:])], schema=shape)
    m = len(buckets)
    lists = [pa.array([b[i] for b in buckets.values()], shape.field(5).type) for i in range(5)]
    return pa.concat_tables([a, pa.table([*(none(m, f) for f in list(shape)[:4]), pa.array(list(buckets), pa.int64()), *lists], schema=shape)])


def locate(table: pa.Table, window: int, phrase: int) -> pa.Table:
    """What one shard's automaton finds in its stretches: rows of FOUND.

    Runs of words in windows that also start in a document of smaller id of the shard. A shard of
    a salted phrase knows only some documents: its other windows go on in buckets of their hashes,
    where those of all salts meet.
    """
    table = table.combine_chunks().sort_by([("doc", "ascending")])
    doc, row, h, lead, salts = (table[c].to_numpy() for c in ("doc", "row", "h", "lead", "salts"))
    w = scan(table["words"].combine_chunks(), spaced(), lower=False)
    text = letters(w.hash)
    # confirmed: two documents of the shard, or of its salts, name the phrase
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    most = np.full(len(one), np.iinfo(np.int64).min)
    np.maximum.at(most, which, doc)
    known = one[(most > doc[one]) | (salts[one] > 1)]
    phrases = [text[a : a + phrase] for a in (w.first[known] + lead[known]).tolist()]
    places: list[int] = []
    if phrases:
        automaton = automaton_of(phrases)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            places += [a + end for end, _ in automaton.iter(text[a:b])]
    if not places:
        return _found([np.zeros(0, np.int64)] * 4, {})
    last = np.array(places)
    of = np.searchsorted(w.first, last, side="right") - 1
    begin = np.maximum(last + 1 - window, w.first[of])  # the windows that hold the place
    end = np.minimum(last - phrase + 1, w.first[of + 1] - window)
    at = np.flatnonzero(covered(len(w.hash), begin, np.maximum(end - begin + 1, 0)))
    of = np.searchsorted(w.first, at, side="right") - 1
    k1, k2 = windows(w.hash, window)[at], windows(mix(w.hash ^ np.uint64(0x5851F42D4C957F2D)), window)[at]
    hit = later(k1, k2, doc[of])
    # a stretch that its text repeats counts at each of its starts
    lists = table["at"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    begins, offset = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]

    def spread(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = of[chosen]
        which = np.repeat(chosen, size[mine])
        return which, gather(begins, offset[mine], size[mine]) + at[which] - w.first[of[which]]

    which, place = spread(np.flatnonzero(hit))
    by = np.lexsort((place, doc[of[which]], row[of[which]]))
    which, place = which[by], place[by]
    hits = runs(row[of[which]], doc[of[which]], place, window)
    which, place = spread(np.flatnonzero(~hit & (salts[of] > 1)))
    buckets: dict[int, list[np.ndarray]] = {}
    if len(which):
        key = (k1[which] % salts[of[which]].astype(np.uint64)).astype(np.int64)
        columns = [x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x for x in (k1[which], k2[which], doc[of[which]], row[of[which]], place)]
        by = np.argsort(key, kind="stable")
        edge = np.append(np.append(0, np.flatnonzero(np.diff(key[by])) + 1), len(by))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            buckets[int(key[by[a]])] = [x[by[a:b]].astype(np.int64) for x in columns]
    return _found(hits, buckets)


def locate_across(table: pa.Table, window: int) -> pa.Table:
    """The repeated windows of one bucket, in which those of all salts of hot phrases meet."""
    k1, k2, doc, row, at = (table[c].combine_chunks().flatten().to_numpy() for c in ("k1", "k2", "docs", "rows", "starts"))
    hit = np.flatnonzero(later(k1, k2, doc))
    hit = hit[np.lexsort((at[hit], doc[hit], row[hit]))]
    found = runs(row[hit], doc[hit], at[hit], window)
    return pa.table(dict(zip(("row", "doc", "at", "to"), (pa.array(x, pa.int64()) for x in found), strict=True)))


def repeated_stretches(docs: DataFrame, *, window: int = WINDOW, phrase: int = PHRASE, bits: int = BITS) -> DataFrame:
    """(row, doc, at, to): words, from 0, in windows that also start in a document of smaller id.

    ``docs`` has row, doc and text.
    """
    listed = map_text(docs, "text", ["doc"], "h array<bigint>", lambda t: phrase_hashes(t, window, phrase)).select("doc", F.explode("h").alias("h"))
    twice = listed.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("places")).where("low < high")
    twice = cut(twice.select("h", "places"), "phrases")
    total = twice.agg(F.sum("places")).first()[0] or 0
    held = docs.sparkSession.sparkContext.broadcast(bit_table(twice, bits))
    found = map_text(docs, "text", ["row", "doc"], "p array<struct<h: bigint, at: array<int>, lead: int, words: string>>", lambda t: stretches(t, held.value, window, phrase))
    found = found.where(F.size("p") > 0).select("row", "doc", F.inline("p"))
    hot = sized(cut(twice.where(F.col("places") > SHARD).select("h", F.ceil(F.col("places") / SHARD).cast("int").alias("salts")), "hot"))
    rows = found.join(hot, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    rows = rows.withColumn("shard", F.when(F.col("salts") > 1, F.xxhash64("h", "salt")).otherwise(F.pmod(F.xxhash64("h"), F.lit(max(1, total // SHARD)))))
    names = ["row", "doc", "h", "at", "lead", "words", "salts"]
    out = cut(rows.groupBy("shard", "salt").applyInArrow(lambda t: locate(t.select(names), window, phrase), FOUND), "found")
    release(twice)
    across = out.where("bucket is not null").groupBy("bucket").applyInArrow(lambda t: locate_across(t, window), "row bigint, doc bigint, at bigint, to bigint")
    return out.where("bucket is null").select("row", "doc", "at", "to").unionByName(across)


def merged(stretches: DataFrame) -> DataFrame:
    """(row, doc, bounds): each row's stretches (row, doc, at, to) as disjoint ones, begins and ends by turns."""

    def run(batches):
        for b in batches:
            out = []
            for at, to in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                bounds: list[int] = []
                for x, y in sorted(zip(at, to, strict=True)):
                    if bounds and x <= bounds[-1]:
                        bounds[-1] = max(bounds[-1], y)
                    else:
                        bounds += [x, y]
                out.append(bounds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["row", "doc", "bounds"])

    lists = stretches.groupBy("row", "doc").agg(F.collect_list("at").alias("at"), F.collect_list("to").alias("to"))
    return lists.mapInArrow(run, "row bigint, doc bigint, bounds array<int>")


def _kept(texts: pa.Array, spans: pa.Array) -> list:
    w = scan(texts, spaced(), lower=False)
    n_words, removed, kept = np.diff(w.first), [], []
    raw, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
    for row, found in enumerate(spans.to_pylist()):
        a, b = int(w.first[row]), int(w.first[row + 1])
        if found:
            at = np.array(found)
            gone = covered(b - a, at[::2], at[1::2] - at[::2])
            left = (np.flatnonzero(~gone) + a).tolist()
            removed.append(b - a - len(left))
            kept.append(b" ".join([raw[start[i] : end[i]] for i in left]).decode())
        else:
            removed.append(0)
            kept.append(b" ".join([raw[x:y] for x, y in zip(start[a:b], end[a:b], strict=True)]).decode())
    return [n_words, removed, kept]


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Each whole text without the words of windows that also start in a document of smaller id.

    Returns the ``keep`` columns (all but the text by default), n_words, n_removed and kept_text
    (the words left, parted by one space). Windows are judged on the input. Null and empty texts
    have no words. Rows without an id, and rows of equal ids, are not earlier than each other;
    rows without an id neither lose words nor take any from others. Ids that are no whole numbers are
    refused. Results replace kept columns of the same names. A task holds one text at least, at
    about 50 times its size.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    ids = whole_id(docs, doc_id)
    key = F.xxhash64(ids, F.col(f"`{text}`"))
    found = repeated_stretches(docs.select(key.alias("row"), ids.alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null"), window=window, phrase=phrase)
    found = cut(merged(found).withColumnsRenamed({"row": "_row", "doc": "_doc", "bounds": "_bounds"}), "stretches")
    few = (found.agg(F.sum(F.size("_bounds"))).first()[0] or 0) <= MAX_LISTED
    rows = docs.withColumns({"_row": key, "_doc": ids}).join(F.broadcast(found) if few else found, ["_row", "_doc"], "left")
    return map_text(rows, text, keep, "n_words bigint, n_removed bigint, kept_text string", _kept, also=("_bounds",))


def op8_phrases(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of what every document keeps."""
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

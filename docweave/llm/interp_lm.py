"""Language-model scores by deleted interpolation.

Maximum-likelihood bigram, unigram and uniform estimates are mixed with weights that depend on
how often the context was seen, in powers of two. Expectation-maximisation learns the weights
from a deleted part of the training texts: estimates come from the rest.

All words and bigrams are counted. Documents are taken in units of one input split. A unit sends
its distinct keys, sorted and packed, to the ranges of keys; a range counts them over all units and
answers each unit with the counts in the order of its keys, so that answers hold no keys. A unit's
documents meet its answers and make the same keys again.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tables import CHUNK_BYTES, chunks, cut, release
from docweave.llm.words import distinct, mix, ranked, scan, spaced

#: Parts of the documents by crc32 of their id: one is held out, one is deleted to learn weights.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Rounds of expectation-maximisation at most.
ROUNDS = 50
#: Bytes of a Parquet split whose documents make a unit.
BLOCK = 8 << 20
#: Bytes of text whose keys make a range, and ranges at least.
RANGE, LEAST_RANGES = 8 << 20, 32

END = int(mix(np.array([0xE0D], np.uint64))[0])


class Model(NamedTuple):
    total: int  # training tokens
    kinds: int  # distinct ones
    weights: np.ndarray  # by bucket: bigram, unigram, uniform


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by its end; the first token of each text; bytes."""
    w = scan(texts, spaced(), lower=True)
    rows = len(w.first) - 1
    ends = w.first[1:] + np.arange(rows)
    out = np.empty(len(w.hash) + rows, np.uint64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = w.hash, END
    return out, np.concatenate([[0], ends + 1]), w.data


def contexts(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[first[:-1]] = start
    return out


def keyed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens (odd) and of their bigrams (even), each text's first token after an end; first tokens."""
    found, first, _ = tokens(texts)
    found = found | np.uint64(1)
    pairs = mix(contexts(found, first, END | 1) * np.uint64(0x9E3779B97F4A7C15) + found)
    return found, pairs & ~np.uint64(1), first


def pack(keys: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Sorted keys as differences, and numbers below 2**32 of each, by byte planes and compressed."""
    planes = [np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T] if keys is not None else []
    planes += [x.astype("<u4").view(np.uint8).reshape(-1, 4).T for x in numbers]
    raw = b"".join(x.tobytes() for x in planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, keys: bool, numbers: int) -> list[np.ndarray]:
    """What pack() got."""
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    n, out, at = size // (8 * keys + 4 * numbers), [], 0
    for width in [8] * keys + [4] * numbers:
        plane = raw[at : at + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(f"<u{width}").ravel())
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]] if keys else out


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of keys begins among sorted ones, and their number."""
    of = ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
    return np.searchsorted(of, np.arange(ranges + 1))


def mark(keys: np.ndarray) -> int:
    """A sum over keys by which a unit knows the answers to its own."""
    return int(mix(keys).sum(dtype=np.uint64).view(np.int64))


def merged(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """A unit's keys in order, from its distinct words and bigrams in order."""
    return np.sort(np.concatenate([words, pairs]), kind="stable")  # merges two sorted runs


def asked(rows: DataFrame, ranges: int) -> DataFrame:
    """(range, unit, deleted, blob): each unit's keys with their training counts.

    ``rows`` has text, fold and unit, those of a unit together.
    """

    def packed(unit, words, pairs, training, deleted):
        some: list[tuple[np.ndarray, np.ndarray]] = []
        for parts in (words, pairs):
            learnt, held = (np.concatenate([x for x, t in zip(parts, training, strict=True) if t == kind]) for kind in (True, False))
            known, count = np.unique(learnt, return_counts=True)
            held = distinct(held)
            every = distinct(np.concatenate([known, held])) if len(held) else known
            n = np.zeros(len(every), np.int64)
            n[np.searchsorted(every, known)] = count
            some.append((every, n))
        keys = merged(some[0][0], some[1][0])
        n = np.zeros(len(keys), np.int64)
        for every, count in some:
            n[np.searchsorted(keys, every)] = count
        edge = ranges_of(keys, ranges).tolist()
        kept = [(i, pack(keys[a:b], n[a:b])) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        m = len(kept)
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int32()), pa.array([unit] * m, pa.int64()), pa.array([deleted] * m, pa.bool_()), pa.array([x for _, x in kept], pa.binary())], names=["range", "unit", "deleted", "blob"])

    def run(batches):
        unit, words, pairs, training, deleted = None, [], [], [], False
        for batch in batches:
            for part in chunks(batch, 0, CHUNK_BYTES):
                fold, units = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                w, p, first = keyed(part.column(0))
                edge = np.append(np.append(0, np.flatnonzero(np.diff(units)) + 1), len(units)).tolist()
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if unit is not None and units[a] != unit:
                        yield packed(unit, words, pairs, training, deleted)
                        words, pairs, training = [], [], []
                    unit, deleted = int(units[a]), bool(fold[a] == DELETED)
                    held = np.repeat(fold[a:b] == HELD_OUT, np.diff(first[a : b + 1]))
                    for mine in (~held, held):
                        words.append(w[first[a] : first[b]][mine])
                        pairs.append(p[first[a] : first[b]][mine])
                        training.append(mine is not held)
        if unit is not None:
            yield packed(unit, words, pairs, training, deleted)

    return rows.select("text", "fold", "unit").mapInArrow(run, "range int, unit bigint, deleted boolean, blob binary")


ANSWERS = "range int, unit bigint, deleted boolean, n bigint, mark bigint, blob binary, total bigint, gone bigint, kinds bigint, most bigint"


def answered(table: pa.Table) -> pa.Table:
    """For each unit, the training counts of its keys of a range, for deleted units those of deleted texts too; and a row of totals."""
    units, blobs, deleted = (table[c].to_pylist() for c in ("unit", "blob", "deleted"))
    keys, counts = zip(*(unpack(b, True, 1) for b in blobs), strict=True)
    size = np.array([len(k) for k in keys])
    gone = np.repeat(np.array(deleted, bool), size)
    every, count = np.concatenate(keys), np.concatenate(counts).astype(np.float64)
    known, which = ranked(every)
    n = np.bincount(which, count, len(known)).astype(np.int64)
    out = np.bincount(which, count * gone, len(known)).astype(np.int64)
    word = (known & np.uint64(1)).astype(bool)
    edge, rows = np.append(0, np.cumsum(size)), []
    place = int(table["range"][0].as_py())
    for unit, apart, a, b in zip(units, deleted, edge[:-1], edge[1:], strict=True):
        rows.append((place, unit, apart, int(b - a), mark(every[a:b]), pack(None, n[which[a:b]], *([out[which[a:b]]] if apart else [])), None, None, None, None))
    rows.append((place, None, None, None, None, None, int(n[word].sum()), int(out[word].sum()), int((n[word] > 0).sum()), int(n[word].max(initial=0))))
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ANSWERS.split(", ")])


def looked_up(texts: list[pa.Array], answers: pa.Table, deleted: bool):
    """For each array of a unit's texts: counts of its tokens, of its bigrams, and first tokens.

    ``deleted``: counts without those of deleted texts, which the answers to deleted units tell.
    """
    found = [keyed(t) for t in texts]
    if not found:
        raise ValueError("a unit that asked has no documents: the input changed while it was read")
    (words, of_word), (pairs, of_pair) = (ranked(np.concatenate([x[i] for x in found])) for i in (0, 1))
    keys = merged(words, pairs)
    answers = answers.sort_by("range")
    if answers["n"].combine_chunks().to_numpy().sum() != len(keys) or sum(answers["mark"].to_pylist()) % 2**64 != mark(keys) % 2**64:
        raise ValueError("a unit's documents are not those that asked: the input changed while it was read")
    parts = [unpack(b, False, 1 + d) for b, d in zip(answers["blob"].to_pylist(), answers["deleted"].to_pylist(), strict=True)]
    n = np.concatenate([x[0] for x in parts]).astype(np.int64)
    if deleted:
        n -= np.concatenate([x[1] for x in parts])
    of_word, of_pair, at = n[np.searchsorted(keys, words)][of_word], n[np.searchsorted(keys, pairs)][of_pair], 0
    for w, _, first in found:
        yield of_word[at : at + len(w)], of_pair[at : at + len(w)], first
        at += len(w)


def beside(rows: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` makes of each unit's rows and answers."""
    found = answers.where("unit is not null").select("range", "unit", "deleted", "n", "mark", "blob")
    return rows.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(work, schema)


def bucket(count: np.ndarray) -> np.ndarray:
    """Contexts' buckets: the power of two of their counts."""
    return np.floor(np.log2(np.asarray(count, np.float64) + 1)).astype(np.int64)


def shares(weights: np.ndarray, group: np.ndarray, parts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of each bucket's held-out counts, what the mixture expects of each estimate."""
    share = weights[group] * parts
    share *= (held / np.maximum(share.sum(1), 1e-300))[:, None]
    return np.stack([np.bincount(group, share[:, i], len(weights)) for i in range(3)], 1)


def settled(step, buckets: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation; ``step`` gives shares() of weights."""
    weights = np.full((buckets, 3), 1 / 3)
    total = np.zeros((buckets, 1))
    for _ in range(rounds):
        new = step(weights)
        total = new.sum(1, keepdims=True)
        new = np.where(total > 0, new / np.maximum(total, 1e-300), weights)
        moved = np.abs(new - weights).max()
        weights = new
        if moved < 1e-6:
            break
    # a bucket without held-out counts takes the weights of the nearest one with some
    some = np.flatnonzero(total[:, 0] > 0)
    if len(some):
        near = some[np.abs(np.arange(buckets)[:, None] - some[None, :]).argmin(1)]
        weights = weights[near]
    return 0.9999 * weights + 0.0001 / 3  # no token is impossible


def learn_weights(context: np.ndarray, of_bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: np.ndarray, held: np.ndarray, buckets: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of each bucket from held-out counts in arrays."""
    parts, group = np.stack([p2, p1, p0], 1), of_bucket[context]
    return settled(lambda weights: shares(weights, group, parts, held), buckets, rounds)


COUNTS = ("context", "both", "alone", "held")


def deleted_counts(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(bucket, context, both, alone, held): of the deleted tokens, counts in what is not deleted, and how many tokens have them.

    ``rows`` are the deleted texts by unit.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        texts = [x.column(0) for b in left.select(["text"]).to_batches() for x in chunks(b, 0, CHUNK_BYTES)]
        for alone, both, first in looked_up(texts, right, True):
            context = contexts(alone, first, alone[first[1] - 1])  # every text has its end
            power = bucket(context)
            context = np.where(both > 0, context, (1 << power) - 1)  # an unseen bigram's context has only a bucket
            by = np.lexsort((alone, both, context))
            columns = [x[by] for x in (power, context, both, alone)]
            new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], 0)]))
            out.append(pa.table([*(x[new] for x in columns), np.diff(np.append(new, len(by)))], names=["bucket", *COUNTS]))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("bucket", *COUNTS)})

    found = beside(rows.select("unit", "text"), answers.where("deleted"), work, "bucket bigint, context bigint, both bigint, alone bigint, held bigint")
    return found.groupBy("bucket", "context", "both", "alone").agg(F.sum("held").alias("held"))


def train(rows: DataFrame, ranges: int) -> tuple[Model, DataFrame]:
    """The model of the training rows among (text, fold, unit), and the written answers to all units."""
    together = rows.select("text", "fold", "unit").sortWithinPartitions("unit")
    answers = cut(asked(together, ranges).groupBy("range").applyInArrow(answered, ANSWERS), "answers")
    some = answers.where("unit is null").agg(*[F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "total"), (F.sum, "gone"), (F.sum, "kinds"), (F.max, "most"))])
    total, deleted, kinds, most = some.first()
    buckets = int(bucket(np.array([most]))[0]) + 1
    if deleted:
        table = cut(deleted_counts(rows.where(F.col("fold") == DELETED), answers), "deleted")

        estimates = F.col("both") / F.greatest("context", F.lit(1)), F.col("alone") / max(1, total - deleted), F.lit(1 / (kinds + 1))

        def step(weights: np.ndarray) -> np.ndarray:
            part = [F.element_at(F.lit(w), F.col("bucket").cast("int") + 1) * x for w, x in zip(weights.T.tolist(), estimates, strict=True)]
            all_ = F.greatest(sum(part[1:], part[0]), F.lit(1e-300))
            sums = table.groupBy("bucket").agg(*[F.sum(x * F.col("held") / all_).alias(f"s{i}") for i, x in enumerate(part)])
            new = np.zeros((buckets, 3))
            for r in sums.collect():  # a row for each bucket
                new[r[0]] = r[1:]
            return new

        weights = settled(step, buckets)
        release(table)
    else:  # nothing was deleted: the parts weigh the same, or the uniform one all if there is no training text
        weights = np.tile([1 / 3, 1 / 3, 1 / 3] if total else [0.0, 0.0, 1.0], (buckets, 1))
    return Model(total, kinds, weights), answers


def score_counts(count: np.ndarray, both: np.ndarray, first: np.ndarray, m: Model) -> list[np.ndarray]:
    """For each text: tokens, known ones, base score, score, from the counts of its tokens and bigrams."""
    context = contexts(count, first, count[first[1] - 1])  # every text has its end
    weights = m.weights[bucket(context)]
    p = weights[:, 0] * (both / np.maximum(context, 1)) + weights[:, 1] * (count / max(1, m.total)) + weights[:, 2] / (m.kinds + 1)
    base = np.log10((count + 1) / (m.total + m.kinds + 1))
    total = lambda x: np.add.reduceat(x, first[:-1])
    return [np.diff(first), total((count > 0).astype(np.int64)), total(base), total(np.log10(p))]


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all whole texts by a model learnt from those not held out.

    Returns id, held_out (crc32 of the id as text, modulo 7, is 2; a null id counts as ""),
    n_tokens (words in lower case and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram) and score (the model's log10 probability). Null and empty texts
    are an end alone. Rows are scored each on their own; extra columns are left out. A task holds
    the keys of a unit, 8 MB of Parquet or one text, at about 40 times its size.
    """
    spark = docs.sparkSession
    if not docs.inputFiles():
        docs = cut(docs, "documents")
    ids = F.col(f"`{doc_id}`")
    fold = F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % FOLDS
    split = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    part = F.pmod(F.xxhash64(ids), F.lit(max(1, -(-split // BLOCK))))
    unit = F.xxhash64(F.input_file_name(), F.input_file_block_start(), part, fold == DELETED)
    rows = docs.select(ids.alias("id"), fold.cast("int").alias("fold"), F.col(f"`{text}`").cast("string").alias("text"), unit.alias("unit"))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    model, answers = train(rows, max(LEAST_RANGES, size // RANGE))
    held = spark.sparkContext.broadcast(model)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "fold", "n_tokens", "n_known", "base_score", "score"]
        parts = [x for b in left.to_batches() for x in chunks(b, 2, CHUNK_BYTES)]
        out = []
        for x, (count, both, first) in zip(parts, looked_up([x.column(2) for x in parts], right, False), strict=True):
            out.append(pa.RecordBatch.from_arrays([x.column(0), x.column(1), *map(pa.array, score_counts(count, both, first, held.value))], names=names))
        return pa.Table.from_batches(out)

    id_type = rows.schema["id"].dataType.simpleString()
    scored = beside(rows, answers, work, f"id {id_type}, fold int, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_score(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")

"""BPE by forced boundaries: fragments between certain cuts are encoded on their own and joined.

A byte pair that occurs inside no vocabulary token can never be merged, so a place between two
such bytes is a certain cut, wherever the pre-tokenizer parts the two as well. Fragments repeat
far more often than documents do; each distinct fragment of a chunk is encoded once.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.tables import map_text
from docweave.llm.words import buffers, gather, hash_parts

#: Distinct fragments that a process remembers; beyond, it starts anew.
MEMO = 1_500_000


def default_vocabulary() -> str:
    """Where the public word-level BPE of 49k tokens lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    """The tokenizer, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def pairs_inside(tokens: list[str], special: list[str] = (), suffix: str = "</w>") -> np.ndarray:
    """Which of the 256 x 256 byte pairs occur inside a token; special tokens are plain text."""
    byte = _byte_of()
    inside = np.zeros((256, 256), bool)
    for token in tokens:
        raw = [byte[c] for c in token.removesuffix(suffix)] if token not in special else list(token.encode())
        for a, b in zip(raw, raw[1:], strict=False):
            inside[a, b] = True
    return inside


def forced_cuts(inside: np.ndarray) -> np.ndarray:
    """Byte pairs between which a text is cut: in no token, and parted by the pre-tokenizer.

    Only ASCII pairs count: no normalisation joins them. The pre-tokenizer parts letters, single
    digits, white space and other characters; an apostrophe may start a contraction and stays
    with what follows. No cut is made before white space, which stays with what it follows.
    """
    kind = np.full(128, 3)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[48:58] = 1
    kind[65:91] = kind[97:123] = 2
    low = np.arange(128)
    low[65:91] += 32
    parted = (kind[:, None] != kind[None, :]) | (kind[:, None] == 1)
    parted &= ~inside[low[:, None], low[None, :]] & (kind[None, :] != 0)
    parted[39, :] = False
    out = np.zeros((256, 256), bool)
    out[:128, :128] = parted
    return out


class Coder:
    """Encodes and decodes texts through their fragments.

    What a fragment becomes is remembered under its 64-bit hash, in arrays sorted by hash.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = forced_cuts(pairs_inside(list(vocabulary), special)).ravel()
        self.shown = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.shown[i] = token.encode()
        self.shown_size = np.array([len(x) for x in self.shown])
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown_bytes = np.frombuffer(b"".join(self.shown), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, key: np.ndarray, fragments: list[bytes]) -> None:
        """Encode fragments that are new, each on its own."""
        made, sizes = [], []
        for at in range(0, len(fragments), 10_000):
            for e in self.tokenizer.encode_batch_fast([x.decode() for x in fragments[at : at + 10_000]], add_special_tokens=False):
                made += e.ids
                sizes.append(len(e.ids))
        size = np.array(sizes, np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array(made, np.uint32)])
        key, at, size = np.concatenate([self.key, key]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(key, kind="stable")
        self.key, self.at, self.size = key[order], at[order], size[order]

    def fragments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all rows, where fragments begin in them, and each row's first fragment."""
        data, at = buffers(texts)
        if not len(data):
            return data, np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        pair = data[:-1].astype(np.uint16) << np.uint16(8)
        pair |= data[1:]
        begins = np.zeros(len(data), bool)
        begins[1:] = self.cuts[pair]
        begins[at[at < len(data)]] = True
        here = np.flatnonzero(begins)
        return data, here, np.searchsorted(here, at)

    def __call__(self, texts: pa.Array):
        """For each text: its ids, and the decoded text as bytes."""
        data, here, first = self.fragments(texts)
        size = np.diff(np.append(here, len(data)))
        keys, index, which = np.unique(hash_parts(data, size), return_index=True, return_inverse=True)
        if len(self.key) > MEMO:
            self.forget()
        place = np.searchsorted(self.key, keys)
        known = np.zeros(len(keys), bool)
        if len(self.key):
            known = self.key[np.minimum(place, len(self.key) - 1)] == keys
        if not known.all():
            raw = data.tobytes()
            new = index[~known]
            self.learn(keys[~known], [raw[a : a + n] for a, n in zip(here[new].tolist(), size[new].tolist(), strict=True)])
            place = np.searchsorted(self.key, keys)
        at, n = self.at[place][which], self.size[place][which]
        ids = gather(self.ids, at, n)
        total = np.concatenate([[0], np.cumsum(n)])[first]
        # the library shows tokens parted by single spaces: a space follows each, but the last of a row
        width = self.shown_size[ids] + 1
        ends = np.cumsum(width)
        shown = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        mask = np.ones(len(shown), bool)
        mask[ends - 1] = False
        shown[mask] = gather(self.shown_bytes, self.shown_at[ids], width - 1)
        until = np.concatenate([[0], ends])[total]
        for a, b, c, d in zip(total[:-1].tolist(), total[1:].tolist(), until[:-1].tolist(), until[1:].tolist(), strict=True):
            yield ids[a:b], shown[c : max(c, d - 1)].tobytes()


def coder(path: str) -> Coder:
    """This process's coder for a vocabulary: it stays while Spark reuses the Python worker."""
    import sys
    import types

    place = sys.modules.setdefault("_docweave_coders", types.ModuleType("_docweave_coders"))
    if path not in vars(place):
        vars(place)[path] = Coder(path)
    return vars(place)[path]


def encode(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Token ids of each whole text; the same as the library's, found fragment by fragment.

    Returns the ``keep`` columns (all but the text by default), n_tokens, and as asked for ids
    (array<int>), decoded (the library's decode of the ids) and ids_sha256, decoded_sha256. Null
    and empty texts have no ids and decode to "". Every row is coded on its own, so repeated rows
    and extra columns do not matter; results replace kept columns of the same names. The
    vocabulary file must lie at the same path on every machine.
    """
    path = vocabulary or default_vocabulary()
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    fields = ["n_tokens bigint", *["ids array<int>"] * ids, *["decoded string"] * decoded, *["ids_sha256 string, decoded_sha256 string"] * digests]

    def work(texts: pa.Array) -> list:
        out: list[list] = [[] for _ in range(1 + ids + decoded + 2 * digests)]
        for found, shown in coder(path)(texts):
            row = [len(found)]
            row += [found.astype(np.int32)] if ids else []
            row += [shown.decode()] if decoded else []
            row += [hashlib.sha256(found.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(shown).hexdigest()] if digests else []
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    return map_text(docs, text, keep, ", ".join(fields), work)


def op9_encode(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's ids and of their decoded text."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], ids=False, digests=True)

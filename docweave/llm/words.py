"""Words of whole text columns, found and hashed with numpy over the column's UTF-8 bytes.

A word's 64-bit hash is a polynomial over its bytes (one random odd factor, one random value for
each byte), mixed at the end; a window's hash is a polynomial over its words' hashes. No step
looks at one word at a time in Python.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is many times as fast as the hashing of np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    by = np.argsort(x)
    x = x[by]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    place = np.empty(len(x), np.int64)
    place[by] = np.cumsum(new) - 1
    return x[new], place


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spaced() -> np.ndarray:
    """Which bytes belong to words that white space (space and 09-0D) ends."""
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Which bytes belong to words of ASCII letters, digits and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = True
    table[128:] = True
    return table


class Words(NamedTuple):
    data: np.ndarray  # bytes of all rows
    row_at: np.ndarray  # where each row's bytes begin; one more than rows
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # the first word of each row; one more than rows


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's place in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_string()).fill_null("")
    _, at, data = a.buffers()
    place = np.frombuffer(at, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[place[0] : place[-1]], place - place[0]


def hash_parts(data: np.ndarray, size: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the consecutive parts, of the given sizes over 0, that make up the bytes."""
    if not len(size):
        return np.zeros(0, np.uint64)
    values = _byte_values()
    if lower:
        values[65:91] = values[97:123]
    begin = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(begin, size)
    powers = np.cumprod(np.full(int(size.max()), 0xD1342543DE82EF95, np.uint64))
    hashed = np.add.reduceat(values[data] * powers[place], begin)
    return mix(hashed + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at the given places, one after the other."""
    begin = np.cumsum(size) - size
    return values[np.arange(size.sum()) - np.repeat(begin - at, size)]


def scan(texts: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """Words of every row; with ``lower``, A-Z count as a-z in the hashes."""
    data, at = buffers(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    inside = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashed = hash_parts(data[inside], end - start, lower)
    return Words(data, at, start, end, hashed, np.searchsorted(start, at).astype(np.int64))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    factor, done, out, width, part = 0x2545F4914F6CDD1D, 0, None, 1, hashes
    rest = n
    power = factor
    while True:
        if rest & 1:  # out covers ``done`` words; part covers ``width``
            if out is None:
                out, scale = part, power
            else:
                m = min(len(out), len(part) - done)
                out = out[:m] + np.uint64(scale) * part[done : done + m]
                scale = scale * power % 2**64
            done += width
        rest >>= 1
        if not rest:
            break
        m = len(part) - width
        part = part[:m] + np.uint64(power) * part[width : width + m]
        width, power = width * 2, power * power % 2**64
    return mix(out[: len(hashes) - n + 1])


def starts(first: np.ndarray, n: int) -> np.ndarray:
    """Where windows of n words begin that stay within one row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.cumsum(count) - count
    return np.arange(count.sum()) - np.repeat(begin, count) + np.repeat(first[:-1], count)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(n: int, start: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n places are within one of the given stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + width, -1)
    return np.cumsum(steps[:-1]) > 0


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the words of each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]

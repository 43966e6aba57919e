"""Exact nearest neighbours by cosine over Arrow batches.

Products of matrices in single precision sort out what is too far from each query; what is left is
scored in double precision, in the order of the values, and only so many neighbours a query are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values of queries, or neighbours of theirs, that a task holds at once; more queries take several passes.
BLOCK = 1 << 22
#: Vectors and queries that are multiplied at once, and pairs that are scored at once.
ROWS, TILE, PAIRS = 2_048, 1_024, 1 << 17


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to decimals, halves away from zero; no negative zero."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.trunc(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, x) + 0.0


def columns_of(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as columns of a matrix, and their norms.

    What has another width, no norm or a value that is no number is a column of zeros, whose
    cosine is 0; its norm is given as 1.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    mine = np.flatnonzero(sizes == width)
    out = np.zeros((width, len(sizes)))
    if width:
        out[:, mine] = values[(np.cumsum(sizes) - sizes)[mine] + np.arange(width)[:, None]]
    with np.errstate(all="ignore"):
        norms = np.zeros(len(sizes))
        for row in out:
            norms += row * row
        norms = np.sqrt(norms)
    odd = ~(np.isfinite(norms) & (norms > 0))
    out[:, odd], norms[odd] = 0.0, 1.0
    return out, norms


class Block:
    """Queries of one width."""

    def __init__(self, place: np.ndarray, vectors: pa.Array, width: int):
        self.place, self.width = place, width
        self.columns, self.norms = columns_of(vectors, width)
        self.unit = np.ascontiguousarray((self.columns / self.norms).T, np.float32)


def blocks_of(vectors: pa.Array) -> list[Block]:
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    places = [(int(w), np.flatnonzero(sizes == w)) for w in np.unique(sizes)]
    return [Block(p, vectors.take(pa.array(p)), w) for w, p in places]


class Nearest:
    """The k best vectors of each query of a block; of equal scores the first to come."""

    def __init__(self, block: Block, k: int, digits: int):
        self.q, self.k, self.digits = block, k, digits
        self.score, self.at = np.full((len(block.place), k), -np.inf), np.full((len(block.place), k), -1, np.int64)

    def meet(self, vectors: pa.Array, base: int) -> None:
        """Vectors whose places are counted from ``base``."""
        columns, norms = columns_of(vectors, self.q.width)
        unit, m = (columns / norms).astype(np.float32), len(norms)
        slack = (self.q.width + 16) * 2.0**-23 + 10.0**-self.digits  # what single precision and rounding may hide
        for t in range(0, len(self.score), TILE):
            near = self.q.unit[t : t + TILE] @ unit
            floor = self.score[t : t + TILE, -1]
            if m > self.k and np.isinf(floor).any():
                floor = np.maximum(floor, np.partition(near, m - self.k, axis=1)[:, m - self.k])
            floor = np.nextafter((floor - slack).astype(np.float32), np.float32(-np.inf))
            hits = np.flatnonzero(near >= floor[:, None])
            for h in range(0, len(hits), PAIRS):
                q, v = np.divmod(hits[h : h + PAIRS], m)
                self._take(q + t, base + v, self._scored(q + t, v, columns, norms))

    def _scored(self, q: np.ndarray, v: np.ndarray, columns: np.ndarray, norms: np.ndarray) -> np.ndarray:
        total = np.zeros(len(q))
        for a, b in zip(self.q.columns, columns, strict=True):
            total += a[q] * b[v]
        with np.errstate(all="ignore"):
            raw = total / (self.q.norms[q] * norms[v])
        return half_up(np.clip(np.where(np.isfinite(raw), raw, 0.0), -1.0, 1.0), self.digits)

    def _take(self, q: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        better = score > self.score[q, -1]
        q, at, score = q[better], at[better], score[better]
        mine = np.unique(q)
        q = np.concatenate([q, np.repeat(mine, self.k)])
        at, score = np.concatenate([at, self.at[mine].ravel()]), np.concatenate([score, self.score[mine].ravel()])
        order = np.lexsort((at, -score, q))
        starts = np.searchsorted(q[order], mine)
        first = order[starts[:, None] + np.arange(self.k)]  # every query has k rows at least: those that it held
        self.score[mine], self.at[mine] = score[first], at[first]


def search(batches: Iterator[pa.RecordBatch], qids: pa.Array, blocks: list[Block], k: int, digits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(qid, id, score) of each query's k best among batches (id, vec), whose order decides between equal scores."""
    found, ids, base = [Nearest(b, k, digits) for b in blocks], [], 0
    for batch in batches:
        ids.append(batch.column(0))
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column(1).slice(at, ROWS)
            for f in found:
                f.meet(part, base)
            base += len(part)
    if not base:
        return
    every = pa.chunked_array(ids)
    for f in found:
        q, i = np.nonzero(f.at >= 0)
        for a in range(0, len(q), PAIRS):
            x, y = q[a : a + PAIRS], i[a : a + PAIRS]
            rows = [qids.take(pa.array(f.q.place[x])), pa.concat_arrays(every.take(pa.array(f.at[x, y])).chunks), pa.array(f.score[x, y])]
            yield pa.RecordBatch.from_arrays([c.cast(s.type) for c, s in zip(rows, schema, strict=True)], schema=schema)

"""Exact top-k search by a bit-sliced index.

Each attribute (a quantised vector component) is stored as bit slices: slice ``b`` is a bitmap over the rows that holds
bit ``b`` of their values.  A query's weighted sum is made by adding slices with bitmap arithmetic, for many queries at
once; a negative weight adds the complement, so all terms are positive.  The index leaves out ``coarse_bits`` low bits
of the values, so a sum is known up to a stated error.  The k-th largest sum is read from the most significant slice
downward, and every row that the error leaves in doubt is resolved by its exact score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def build_slices(values: np.ndarray, coarse_bits: int) -> np.ndarray:
    """Bit slices of (rows, attributes): bitmaps indexed [attribute, bit], of values above the block's least."""
    y = (values - values.min()) >> coarse_bits
    bits = max(1, int(y.max()).bit_length())
    n = -(-len(y) // 64) * 64
    out = np.zeros((values.shape[1], bits, n // 8), dtype=np.uint8)
    for b in range(bits):
        out[:, b, : -(-len(y) // 8)] = np.packbits((y >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
    return out.view(np.uint64)


def _add(total: list[np.ndarray], extra: list[np.ndarray], at: int) -> None:
    """Adds the bit-sliced number ``extra``, shifted by ``at``, into ``total`` (both grow upward from the lowest slice)."""
    carry = None
    for i, z in enumerate(extra):
        while len(total) <= at + i:
            total.append(np.zeros_like(z))
        a = total[at + i]
        half = a ^ z
        if carry is None:
            carry, total[at + i] = a & z, half
        else:
            total[at + i] = half ^ carry
            half &= carry
            carry = a & z
            carry |= half
    i = at + len(extra)
    while carry is not None and carry.any():
        if len(total) <= i:
            total.append(carry)
            break
        carry, total[i] = total[i] & carry, total[i] ^ carry
        i += 1


def weighted_sums(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices of sum |w| y for every query, where y is complemented under a negative weight: [bit] -> (query, word)."""
    attributes, bits, words = slices.shape
    size = np.abs(weights)
    total: list[np.ndarray] = []
    shape = (len(weights), words)
    for c in range(int(size.max(initial=0)).bit_length()):
        partial: list[np.ndarray] = []
        chosen = np.where(size >> c & 1, _ONES, np.uint64(0))  # (query, attribute)
        flip = np.where(weights < 0, chosen, np.uint64(0))
        for d in range(attributes):
            if chosen[:, d].any():
                on, turned = chosen[:, d, None], flip[:, d, None]
                _add(partial, [(slices[d, b] & on) ^ turned for b in range(bits)], 0)
        _add(total, partial, c)
    return total or [np.zeros(shape, np.uint64)]


def kth_largest(total: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th largest sum among its rows (0 if it has fewer), from the top slice downward."""
    above, even, value = np.zeros_like(rows), rows.copy(), np.zeros(len(rows), np.int64)
    for bit in range(len(total) - 1, -1, -1):
        ones = even & total[bit]
        enough = np.bitwise_count(above | ones).sum(axis=1, dtype=np.int64) >= k
        value |= enough.astype(np.int64) << bit
        above = np.where(enough[:, None], above, above | ones)
        even = np.where(enough[:, None], ones, even & ~total[bit])
    return value


def at_least(total: list[np.ndarray], rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmap of each query's rows whose sum is ``bound`` or more."""
    more, even = np.zeros_like(rows), rows.copy()
    bound = np.maximum(bound, 0)
    for bit in range(len(total) - 1, -1, -1):
        wanted = np.where(bound >> bit & 1, _ONES, np.uint64(0))[:, None]
        more |= even & total[bit] & ~wanted
        even &= ~(total[bit] ^ wanted)
    return more | even


def block_top(k: int, coarse_bits: int = 2, batch: int = 64):
    """The search of one block, see :func:`blocks.search`."""

    def top(ids, vectors, query_ids, queries):
        x, w = vectors.astype(np.int64), queries.astype(np.int64)
        slices = build_slices(x, coarse_bits)
        words = slices.shape[2]
        there = np.packbits(np.arange(words * 64) < len(x), bitorder="little").view(np.uint64)
        by_id = np.argsort(ids, kind="stable")
        out = []
        for at in range(0, len(w), batch):
            q, own = w[at : at + batch], query_ids[at : at + batch]
            rows = np.repeat(there[None], len(q), axis=0)
            for i, (a, b) in enumerate(zip(np.searchsorted(ids, own, "left", by_id), np.searchsorted(ids, own, "right", by_id), strict=True)):
                for r in by_id[a:b]:  # a query is no candidate of its own
                    rows[i, r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
            total = weighted_sums(slices, q)
            doubt = ((1 << coarse_bits) - 1) * np.abs(q).sum(axis=1) >> coarse_bits
            left = at_least(total, rows, kth_largest(total, rows, k) - doubt)
            i, r = np.nonzero(np.unpackbits(left.view(np.uint8), axis=1, bitorder="little"))
            score = np.einsum("nd,nd->n", q[i], x[r])
            order = np.lexsort((ids[r], -score, i))
            i, r, score = i[order], r[order], score[order]
            first = np.searchsorted(i, np.arange(len(q)))
            best = np.arange(len(i)) - first[i] < k
            out.append((own[i[best]], ids[r[best]], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return top


def exact_top_k(vectors: DataFrame, query: Column, k: int = 5, scale: int = 256, coarse_bits: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: each query's ``k`` largest integer inner products, ties to the smaller id.

    Components become ``floor(scale * x)``.  ``query`` is a condition on ``vec_id``.  A query's own id is no candidate.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; vectors meet
    only vectors of their own length.  A repeated id is a candidate each time it occurs, and as a query is answered
    once for all of its rows.  Scores must fit in 64 bits.  Other columns are not read.
    """
    whole = blocks.usable(vectors, id_col, vector_col, True).withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")))
    return blocks.search(whole, query, k, block_top(k, coarse_bits), "long")

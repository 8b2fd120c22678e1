"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately against two codebooks; a pair of centroids is a cell.  Every row is quantised
once, into a table that names its cell, and the cells' sizes are counted over all rows.  Cells are laid out in blocks of bounded
size, each with the rows of its cells in lists one after another; a cell that is larger than a block has several.

A query ranks the centroids of each half by their distance to its own half and walks the pairs in order of the summed distance
with a heap until the cells hold enough rows; where it stops is its cutoff.  It is sent only to blocks with a cell that it has
walked.  A block goes through its cells: the queries that have walked a cell meet its list in one matrix product, so exactly
the rows of walked cells are touched, and what may be among a query's best is reranked by its true score.  The distance of a half
is its negative inner product, so the order of the cells follows the score that is wanted.

The codebooks are fitted on a bounded sample; every row is indexed.  Vectors of lengths that are too rare in the sample for
a codebook are compared exactly.
"""

from __future__ import annotations

import heapq

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace
from . import blocks

#: Rows of the sample that a codebook needs; a sample of 8,192 rows has 32 codebooks at most.
LEAST_POINTS = 256
Books = dict[int, tuple[np.ndarray, np.ndarray]]


def fit_codebook(points: np.ndarray, centroids: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means over the sample; a centroid without points stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    book = distinct[rng.permutation(len(distinct))[:centroids]].copy()
    for _ in range(rounds):
        nearest = quantise(points, book)
        count = np.bincount(nearest, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, nearest, points)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book


def quantise(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point."""
    return ((book**2).sum(axis=1)[None] - 2 * points @ book.T).argmin(axis=1)


def walk_cells(first: np.ndarray, second: np.ndarray):
    """Pairs (i, j) by ascending ``first[i] + second[j]``, lazily."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def cutoff(first: np.ndarray, second: np.ndarray, size: dict[int, int], enough: int) -> float:
    """The summed distance of the cell with which a walk has met ``enough`` rows."""
    met = 0
    for i, j in walk_cells(first, second):
        met += size.get(i * len(second) + j, 0)
        if met >= enough:
            return float(first[i] + second[j])
    return np.inf


def _halves(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    return -vectors[:, :half] @ books[0].T, -vectors[:, half:] @ books[1].T


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a batch with columns ``dim`` and ``v``."""
    dim = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    lists = batch.column(batch.schema.get_field_index("v"))
    for d in np.unique(dim):
        rows = np.flatnonzero(dim == d)
        yield int(d), rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def index(rows: DataFrame, books: Books) -> DataFrame:
    """``rows`` with the number of their cell, -1 where there is no codebook."""

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            for dim, own, v in _by_length(batch):
                if dim in books:
                    one, two = books[dim]
                    cell[own] = quantise(v[:, : one.shape[1]], one) * len(two) + quantise(v[:, one.shape[1] :], two)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int"
    return rows.mapInArrow(quantised, schema)


@dataclass(frozen=True)
class Layout:
    """Where the rows of one length lie: a cell's first block and how many it has, or only a number of blocks without codebooks."""

    blocks: int
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    def of_rows(self, cells: np.ndarray, deal: np.ndarray) -> np.ndarray:
        """The blocks of rows in the given cells; ``deal`` spreads the rows of a large cell."""
        return deal % self.blocks if self.first is None else self.first[cells] + deal % self.parts[cells]

    def of_cells(self, walked: np.ndarray) -> np.ndarray:
        """All blocks of the given cells."""
        if self.first is None:
            return np.arange(self.blocks)
        hit = np.zeros(self.blocks + 1, np.int64)
        np.add.at(hit, self.first[walked], 1)
        np.add.at(hit, self.first[walked] + self.parts[walked], -1)
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0)


def lay_out(sizes: np.ndarray, rows_per_block: int) -> Layout:
    """Blocks of whole cells in their order, about ``rows_per_block`` rows each; a larger cell has blocks of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held = 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > rows_per_block:
            block, held = block + 1, 0
        first[cell], parts[cell] = block, max(1, -(-n // rows_per_block))
        held += n
        if parts[cell] > 1:
            block, held = block + int(parts[cell]), 0
    return Layout(block + 1, first, parts)


def in_blocks(rows: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """Indexed ``rows`` with their ``block``."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell, deal = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "cell", "deal"))
            block = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dim):
                own = dim == d
                block[own] = layouts[int(d)].of_rows(cell[own], deal[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*batch.schema.names, "block"])

    dealt = rows.withColumn("deal", F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", block int"
    return dealt.mapInArrow(placed, schema).drop("deal")


def _slack(queries: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What a query's summed distances may differ by when they are computed in another batch."""
    longest = max(float(np.linalg.norm(book, axis=1).max()) for book in books)
    return 1e-12 * longest * np.linalg.norm(queries, axis=1)


def sent_to_blocks(queries: DataFrame, books: Books, sizes: dict[int, dict[int, int]], layouts: dict[int, Layout], share: float, least: int) -> DataFrame:
    """Queries with their ``cutoff`` (the summed distance up to which cells are theirs), once for each ``block`` that they meet."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows, block, limit = [], [], []
                for dim, own, v in _by_length(batch):
                    if dim not in books:
                        found = [(np.inf, np.arange(layouts[dim].blocks))] * len(own)
                    else:
                        enough, found = max(least, int(share * sum(sizes[dim].values()))), []
                        filled = np.array(sorted(sizes[dim]), np.int64)
                        for a, b, slack in zip(*_halves(v, books[dim]), _slack(v, books[dim]), strict=True):
                            stop = cutoff(a, b, sizes[dim], enough)
                            near = a[filled // len(b)] + b[filled % len(b)] <= stop + slack
                            found.append((stop, layouts[dim].of_cells(filled[near])))
                    for i, (stop, blocks_) in zip(own, found, strict=True):
                        rows += [i] * len(blocks_)
                        block += blocks_.tolist()
                        limit += [stop] * len(blocks_)
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block, pa.int32()), pa.array(limit, pa.float64())], names=[*batch.schema.names, "block", "cutoff"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields) + ", block int, cutoff double"
    return queries.mapInArrow(walked, schema)


def block_top(k: int, books: Books, touched: list[int] | None = None, batch: int = 256):
    """The search of one block, see :func:`blocks.search_blocks`.  ``touched`` gets the number of rows that each query met."""

    def top(ids, vectors, cells, query_ids, queries, cutoffs):
        known = books.get(vectors.shape[1])
        order = np.argsort(cells, kind="stable")
        ids, vectors, cells = ids[order], vectors[order], cells[order]
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        ends, lists = np.r_[starts[1:], len(cells)], cells[starts]
        out = []
        for at in range(0, len(queries), batch):
            q, own, limits = queries[at : at + batch], query_ids[at : at + batch], cutoffs[at : at + batch]
            if known is None:
                mine = np.ones((len(q), len(lists)), bool)
            else:
                near_one, near_two = _halves(q, known)
                mine = near_one[:, lists // len(known[1])] + near_two[:, lists % len(known[1])] <= (limits + _slack(q, known))[:, None]
            best: list[list] = [[] for _ in q]
            for c, (a, b) in enumerate(zip(starts, ends, strict=True)):
                asking = np.flatnonzero(mine[:, c])
                if len(asking):
                    for i, scores in zip(asking.tolist(), q[asking] @ vectors[a:b].T, strict=True):
                        best[i].append((a, scores))
            for i, found in enumerate(best):
                if not found:
                    continue
                rows = np.concatenate([np.arange(a, a + len(s)) for a, s in found])
                score = np.concatenate([s for _, s in found])
                if touched is not None:
                    touched.append(len(rows))
                other = ids[rows] != own[i]
                rows, score = rows[other], score[other]
                if len(rows) > k:
                    # A product's sums may round otherwise than the score that is returned.
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    rows = rows[score >= least - 1e-9 * np.abs(score).max()]
                score = np.einsum("nd,d->n", vectors[rows], q[i])
                first = np.lexsort((ids[rows], -score))[:k]
                out.append((np.full(len(first), own[i]), ids[rows[first]], score[first]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (query_ids[:0], ids[:0], np.zeros(0))

    return top


def nearest(vectors: DataFrame, query: Column, k: int = 20, centroids: int = 128, share: float = 0.38, least: int = 400, sample_rows: int = 8192, block_bytes: int = 32 << 20, chunk_queries: int = 16_384, least_blocks: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found per query, ties to the smaller id.

    ``query`` is a condition on ``vec_id``.  A query gathers ``share`` of all rows of its length (``least`` at least), the nearest
    cells first.  ``sample_rows`` bounds the rows on which the codebooks are fitted (the smallest hashes of the ids); all rows
    are indexed.  A query's own id is no candidate; rows that repeat an id each take part.  Vectors that are null, empty, zero,
    or hold null or non-finite components take no part, nor do null ids; vectors meet only vectors of their own length.  Other
    columns are not read; an empty table gives no rows.
    """
    work = Workspace(vectors.sparkSession, "multi-index")
    rows = blocks.usable(vectors, id_col, vector_col, False)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).select("dim", "v").toPandas()
    books: Books = {}
    for dim, own in sample.groupby("dim"):
        if len(own) >= LEAST_POINTS and dim > 1:
            points = np.array(own["v"].tolist(), dtype=np.float64)
            half = (int(dim) + 1) // 2
            books[int(dim)] = fit_codebook(points[:, :half], centroids), fit_codebook(points[:, half:], centroids)
    indexed = work.save(index(rows, books), "index")
    sizes: dict[int, dict[int, int]] = {dim: {} for dim in books}
    # At most centroids ** 2 cells for each codebook.
    for dim, cell, n in indexed.filter("cell >= 0").groupBy("dim", "cell").agg(F.count("*").alias("n")).collect():
        sizes[dim][cell] = n
    counts = {r["dim"]: r["n"] for r in indexed.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    layouts = {}
    for dim, n in counts.items():
        per_block = max(1, min(block_bytes // (8 * dim), -(-n // least_blocks)))
        own = np.zeros(len(books[dim][0]) * len(books[dim][1]), np.int64) if dim in books else None
        if own is not None:
            own[list(sizes[dim])] = list(sizes[dim].values())
        layouts[dim] = Layout(-(-n // per_block)) if own is None else lay_out(own, per_block)
    queries = indexed.filter(query).select("dim", "vec_id", "v")
    chunks = max(1, -(-queries.count() // chunk_queries))
    asked = sent_to_blocks(queries, books, sizes, layouts, share, least)
    return blocks.search_blocks(in_blocks(indexed, layouts), asked, k, block_top(k, books), "double", chunks, entry="cell", aside="cutoff")

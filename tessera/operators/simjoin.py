"""Similarity joins of 64-bit signatures under a Hamming threshold.

Equal signatures are collapsed first, so the candidates are distinct signatures.  ``candidates='exact'`` and ``'auto'`` lose
nothing, by one of two plans.  Lookups cut the signature into few wide bands and look each band up at all values within a small
radius: with t bits over m bands, r = t // m and a = t % m, a pair within t bits agrees on one of the first a + 1 bands up to r
bits or on another up to r - 1 bits.  The product compares all signatures in blocks; a comparison takes a few nanoseconds there,
against a microsecond or more for a row that is looked up.  :func:`choose_plan` takes the cheaper one, by the number of
signatures and, where that does not decide, by how often the bands' values recur.  ``candidates='lsh'`` uses the few bands of the
classic scheme and may lose pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..tables import Workspace
from .components import connected_components, contract

#: Distance presets.
STRICT, NORMAL, LOOSE, DEFAULT_THRESHOLD = 5, 8, 10, 8


#: A band value with more signatures than this is split over several tasks.
BUCKET_ROWS = 2000
#: Measured CPU seconds: of one comparison in a block, one row that is looked up, one pair that a lookup meets.
COMPARISON_S, LOOKUP_S, MEETING_S = 2e-9, 1.5e-6, 6e-8
#: Signatures of a block of the product, and the least number of blocks (so that all cores have work).  Blocks are large, so that what
#: tiles hand on grows with the signatures and not with their square.
BLOCK, LEAST_BLOCKS = 524_288, 8
#: Of a tile that is looked up: bands, most radius, candidates at once; measured CPU seconds of a comparison of all pairs, a candidate and a lookup.
TILE_BANDS, TILE_RADIUS, CANDIDATES = 3, 2, 500_000
TILE_COMPARISON_S, TILE_CANDIDATE_S, TILE_LOOKUP_S = 3.4e-9, 2e-8, 1e-8
#: Up to so many rows a signature, rows are compared themselves, so that no pair of signatures need be joined with its rows.
COPIES = 2
#: Signatures of a block where a first look at each is enough.
SMALL_BLOCK = 8_192
#: Comparisons at once (in the processor's cache), hits that are handed on together, and the most tasks of a product.
STEP, HITS, MOST_TASKS = (16, 4_096), 200_000, 2_000
#: Up to so many bands, different candidate pairs are counted by sets of bands.
SUBSET_BANDS = 8
#: Signatures by which the recurrence of band values is measured.
SAMPLE = 20_000
Layout = list[tuple[int, int, int]]


def check_threshold(threshold: int, bits: int = 64) -> int:
    if not 0 <= threshold <= bits:
        raise ValueError(f"threshold must be between 0 and {bits}, not {threshold}")
    return threshold


def banded(distinct: DataFrame, bands: int) -> DataFrame:
    """Rows ``(band, value, h)`` of each signature."""
    layout = S.band_layout(bands)
    entries = F.array(*[F.struct(F.lit(i).alias("band"), S.band(F.col("h"), i, start, width).alias("value")) for i, (start, width) in enumerate(layout)])
    return distinct.select("h", F.explode(entries).alias("e")).select("e.band", "e.value", "h")


def candidate_pairs(distinct: DataFrame, bands: int, min_matching: int = 1) -> DataFrame:
    """Pairs ``(h_a, h_b)``, ``h_a < h_b``, of signatures that share ``min_matching`` bands or more."""
    rows = banded(distinct, bands)
    left, right = rows.select("band", "value", F.col("h").alias("h_a")), rows.select("band", "value", F.col("h").alias("h_b"))
    pairs = left.join(right, ["band", "value"]).filter("h_a < h_b")
    return pairs.groupBy("h_a", "h_b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_matching).select("h_a", "h_b")


def probe_layout(threshold: int, bands: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(start, width, radius) of bands such that a pair within the threshold agrees on one of them up to its radius."""
    radius, left = divmod(threshold, bands)
    layout = [(start, width, radius if i <= left else radius - 1) for i, (start, width) in enumerate(S.band_layout(bands, bits))]
    return [x for x in layout if x[2] >= 0]


def _probes(layout: list[tuple[int, int, int]]) -> int:
    return sum(sum(comb(width, k) for k in range(radius + 1)) for _, width, radius in layout)


def _layouts(threshold: int, most_probes: int = 3000) -> list[Layout]:
    return [x for m in range(1, threshold + 2) if _probes(x := probe_layout(threshold, m)) <= most_probes]


def _lookup_cost(n: int, layout: Layout, recurrence: dict[tuple[int, int], float]) -> float:
    """CPU seconds of a layout: rows that are looked up, and pairs met.  ``recurrence`` is the share of pairs that agree on a band, at
    least that of even values; values nearby are taken to be as frequent."""
    met = sum(max(recurrence.get((start, width), 0.0), 2.0**-width) * sum(comb(width, k) for k in range(radius + 1)) for start, width, radius in layout)
    return n * (_probes(layout) + len(layout)) * LOOKUP_S + n * n * met * MEETING_S


def band_recurrence(distinct: DataFrame, n: int, bands: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """For each band (start, width), the share of pairs of signatures that agree on it, among about ``SAMPLE`` of them."""
    some = distinct.filter(F.pmod(F.xxhash64("h"), F.lit(max(1, n // SAMPLE))) == 0)
    entries = F.array(*[F.struct(F.lit(i).alias("i"), S.band(F.col("h"), i, start, width).alias("value")) for i, (start, width) in enumerate(bands)])
    counts = some.select(F.explode(entries).alias("e")).groupBy("e.i", "e.value").agg(F.count("*").alias("n"))
    rows = counts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1)")).alias("same")).collect()
    return {bands[r.i]: r.same / (r.n * (r.n - 1)) for r in rows if r.n > 1}


def choose_plan(distinct: DataFrame, n: int, threshold: int) -> Layout | None:
    """The cheapest layout for ``n`` signatures, or None where the product is cheaper than all of them."""
    layouts, product = _layouts(threshold), n * n / 2 * COMPARISON_S
    if not layouts or product <= min(_lookup_cost(n, x, {}) for x in layouts):
        return None
    measured = band_recurrence(distinct, n, sorted({(start, width) for x in layouts for start, width, _ in x}))
    best = min(layouts, key=lambda x: _lookup_cost(n, x, measured))
    return best if _lookup_cost(n, best, measured) < product else None


def _blocks(rows: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """Rows ``(block, <column>s)``: the rows, none of which is null, dealt to blocks by a hash of the first column, as arrays."""
    return rows.groupBy(F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).cast("int").alias("block")).agg(*[F.collect_list(c).alias(c) for c in columns])


def _tiles(packed: DataFrame, columns: list[str], ones: Column, others: Column, tiles: int, more: DataFrame | None = None) -> DataFrame:
    """Rows ``(i, j, side, <column>s)``: blocks ``i`` (side 0) and ``j`` (side 1) of each tile, one after the other in a partition.
    A block is side 0 of the tiles ``(block, ones)`` and side 1 of the tiles ``(others, block)``; the blocks of side 0 are those
    of ``more``, if it is given.  A tile of a block with itself has side 0 alone: the arrays of a block are gathered once for each side, in
    the order in which executors hand rows on, so two copies of a block need not agree on places."""
    first = packed if more is None else more
    left = first.select(F.col("block").alias("i"), F.explode(ones).alias("j"), F.lit(0).alias("side"), *columns)
    right = packed.select(F.explode(others).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), *columns).filter("i <> j")
    return left.union(right).repartition(max(1, min(4 * tiles, MOST_TASKS)), "i", "j").sortWithinPartitions("i", "j", "side")


def _all_tiles(rows: DataFrame, columns: list[str], n: int, block: int) -> DataFrame:
    """The tiles of every pair of blocks, once."""
    blocks = max(LEAST_BLOCKS, -(-n // block))
    b, last = F.col("block"), F.lit(blocks - 1)
    return _tiles(_blocks(rows, columns, blocks), columns, F.sequence(b, last), F.sequence(F.lit(0), b), blocks * (blocks + 1) // 2)


def _hits(x: np.ndarray, y: np.ndarray, low: int, high: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both and distances of the pairs within ``low`` and ``high`` bits, about ``HITS`` at once; each pair of a block with itself once."""
    held, size = [], 0
    for a in range(0, len(x), STEP[0]):
        one = x[a : a + STEP[0], None]
        for b in range((a // STEP[1]) * STEP[1] if same else 0, len(y), STEP[1]):
            two = y[None, b : b + STEP[1]]
            apart = np.bitwise_count(one ^ two).ravel()
            at = np.flatnonzero(apart <= high)
            if low:
                at = at[apart[at] >= low]
            if not len(at):
                continue
            i, j = np.divmod(at, two.shape[1])
            i, j, apart = i + a, j + b, apart[at]
            if same:
                once = i < j
                i, j, apart = i[once], j[once], apart[once]
            held.append((i, j, apart.astype(np.int64)))
            size += len(i)
            if size >= HITS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _within(x: np.ndarray, y: np.ndarray, layout: Layout) -> Iterator[np.ndarray]:
    """For each band of the layout: do ``x`` and ``y`` agree on it up to its radius?"""
    apart = x ^ y
    for start, width, radius in layout:
        yield np.bitwise_count((apart >> np.uint64(start)) & np.uint64((1 << width) - 1)) <= radius


def _tile_layout(x: np.ndarray, y: np.ndarray, high: int) -> Layout | None:
    """The bands by which a tile is looked up, or None where comparing all of its pairs is cheaper, by some of its pairs."""
    layout = probe_layout(high, TILE_BANDS)
    if max(radius for *_, radius in layout) > TILE_RADIUS or not len(x) or not len(y):
        return None
    some, others = x[:: -(-len(x) // 64)], y[:: -(-len(y) // 4096)]
    met = sum(float(agree.mean()) for agree in _within(some[:, None], others[None], layout))
    lookups = (len(x) * _probes(layout) + sum(1 << width for _, width, _ in layout)) * TILE_LOOKUP_S
    return layout if lookups + len(x) * len(y) * met * TILE_CANDIDATE_S < len(x) * len(y) * TILE_COMPARISON_S else None


def _looked_up(x: np.ndarray, y: np.ndarray, low: int, high: int, same: bool, layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What :func:`_hits` gives, by looking the bands of ``x`` up in ``y`` at all values within their radius.  A pair counts in the first
    band that finds it."""
    held, size = [], 0
    for k, (start, width, radius) in enumerate(layout):
        v, w = (((z >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64) for z in (x, y))
        order_x, order_y = np.argsort(v, kind="stable"), np.argsort(w, kind="stable")
        v, x_k, y_k = v[order_x], x[order_x], y[order_y]
        first = np.zeros((1 << width) + 1, np.int32)
        np.cumsum(np.bincount(w, minlength=1 << width), out=first[1:])
        for bits in (b for r in range(radius + 1) for b in combinations(range(width), r)):
            flip = sum(1 << b for b in bits)
            # Of a block with itself, a pair is met from the side whose highest flipped bit is not set.
            at = np.flatnonzero((v >> bits[-1]) & 1 == 0) if same and bits else np.arange(len(v))
            value = v[at] ^ flip
            begin, n = first[value], first[value + 1] - first[value]
            some = np.flatnonzero(n)
            at, begin, n = at[some], begin[some], n[some]
            ends = np.cumsum(n, dtype=np.int64)
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(CANDIDATES, ends[-1] if len(ends) else 0, CANDIDATES)), len(at)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n_ab, before = n[a:b], ends[a - 1] if a else 0
                i = np.repeat(at[a:b], n_ab)
                j = np.arange(len(i)) + np.repeat(begin[a:b] - (ends[a:b] - n_ab - before), n_ab)
                apart = np.bitwise_count(x_k[i] ^ y_k[j])
                met = np.flatnonzero((apart <= high) & (apart >= low) if low else apart <= high)
                i, j, apart = i[met], j[met], apart[met]
                once = i < j if same and not bits else np.ones(len(i), bool)
                for agree in _within(x_k[i], y_k[j], layout[:k]):
                    once &= ~agree
                held.append((order_x[i[once]], order_y[j[once]], apart[once].astype(np.int64)))
                size += int(once.sum())
                if size >= HITS:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _near(x: np.ndarray, y: np.ndarray, low: int, high: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both and distances of the pairs within ``low`` and ``high`` bits, each once, by the cheaper of two ways."""
    layout = _tile_layout(x, y, high)
    yield from _hits(x, y, low, high, same) if layout is None else _looked_up(x, y, low, high, same, layout)


def _compared(found: Callable, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``found(left, right, same)`` for each tile with the columns of its two blocks, and hands on the arrays that it yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, key = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, side = (batch.column(c)[k].as_py() for c in range(3))
                arrays = [batch.column(c)[k].values for c in range(3, batch.num_columns)]
                if side == 0:
                    left, key = arrays, (i, j)
                if i == j or side == 1 and key == (i, j):  # a block may be empty
                    for columns in found(left, arrays, i == j):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _unsigned(h: pa.Array) -> np.ndarray:
    return h.to_numpy(zero_copy_only=False).view(np.uint64)


def product_pairs(distinct: DataFrame, threshold: int, n: int, block: int = BLOCK) -> DataFrame:
    """Pairs ``(h_a, h_b, distance)`` by comparing all signatures, block by block.

    Signatures are dealt to blocks by a hash; a tile is a pair of blocks, whose signatures are compared in one task.
    """

    def found(left, right, same):
        x, y = _unsigned(left[0]), _unsigned(right[0])
        for i, j, d in _near(x, y, 0, threshold, same):
            a, b = x[i].view(np.int64), y[j].view(np.int64)
            yield np.minimum(a, b), np.maximum(a, b), d.astype(np.int32)

    tiles = _all_tiles(distinct.select("h"), ["h"], n, block)
    return tiles.mapInArrow(_compared(found, ["h_a", "h_b", "distance"]), "h_a long, h_b long, distance int")


def product_rows(rows: DataFrame, threshold: int, n: int, carried: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Pairs ``(a, b, distance)``, ``a < b``, of rows ``(id, h)`` by comparing all of them, block by block, so no pair is shuffled.
    ``carried`` columns, of numbers that are not null, come along as ``<column>_a`` and ``<column>_b``."""
    columns = ["id", "h", *carried]

    def found(left, right, same):
        x, y = _unsigned(left[1]), _unsigned(right[1])
        left, right = ([c.to_numpy(zero_copy_only=False) for c in (side[0], *side[2:])] for side in (left, right))
        for i, j, d in _near(x, y, 0, threshold, same):
            ordered = left[0][i] < right[0][j]
            pair = [(np.where(ordered, p[i], q[j]), np.where(ordered, q[j], p[i])) for p, q in zip(left, right, strict=True)]
            yield [*pair[0], d.astype(np.int32), *[c for both in pair[1:] for c in both]]

    names = ["a", "b", "distance", *[f"{c}_{side}" for c in carried for side in "ab"]]
    kind = {f.name: f.dataType.simpleString() for f in rows.select(*columns).schema}
    types = [kind["id"], kind["id"], "int", *[kind[c] for c in carried for _ in "ab"]]
    tiles = _all_tiles(rows.select(*columns), columns, n, block)
    return tiles.mapInArrow(_compared(found, names), ", ".join(f"{name} {t}" for name, t in zip(names, types, strict=True)))


def distance_counts(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows ``(distance, pairs)``: how many pairs of rows ``(id, h)`` have each distance within the threshold.  Pairs are counted where
    signatures are compared, so none is kept."""
    check_threshold(threshold)
    counts = signature_counts(rows)

    def found(left, right, same):
        (x, n_x), (y, n_y) = ((_unsigned(side[0]), side[1].to_numpy(zero_copy_only=False)) for side in (left, right))
        total = np.zeros(threshold + 1, np.int64)
        for i, j, d in _near(x, y, 0, threshold, same):
            np.add.at(total, d, n_x[i] * n_y[j])
        known = np.flatnonzero(total)
        yield known.astype(np.int32), total[known]

    different = _all_tiles(counts.select("h", "n"), ["h", "n"], counts.count(), BLOCK).mapInArrow(_compared(found, ["distance", "pairs"]), "distance int, pairs long")
    copies = counts.filter("n > 1").select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return different.union(copies).groupBy("distance").agg(F.sum("pairs").alias("pairs"))


def signature_counts(rows: DataFrame) -> DataFrame:
    """Rows ``(h, first, n)``: each signature, its smallest row and the number of its rows, written once."""
    counts = rows.filter("id IS NOT NULL AND h IS NOT NULL").groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return Workspace(rows.sparkSession, "counts").save(counts, "rows")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels of nodes ``a`` and ``b`` made equal."""
    one, two = label[a], label[b]
    apart = one != two
    if not apart.any():
        return label
    nodes, lowest = contract(one[apart], two[apart])
    new = np.arange(len(label))
    new[nodes] = lowest
    return new[label]


def _forest(low: int, high: int):
    """For each tile ``(h, other)``: edges that connect what its pairs within ``low`` and ``high`` bits connect, fewer than its signatures."""

    def found(left, right, same):
        x, y = _unsigned(left[0]), _unsigned(right[0])
        label, shift = np.arange(len(x) if same else len(x) + len(y)), 0 if same else len(x)
        for i, j, _ in _near(x, y, low, high, same):
            label = _joined(label, i, j + shift)
        h = (x if same else np.concatenate([x, y])).view(np.int64)
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield h[moved], h[label[moved]]

    return _compared(found, ["h", "other"])


def spanning_edges(counts: DataFrame, low: int, high: int, block: int = SMALL_BLOCK) -> DataFrame:
    """Edges ``(h, other)`` that connect the same signatures as all pairs within ``low`` and ``high`` bits.

    Blocks are compared with themselves and the next one; then the signatures outside of the largest component, each with all
    others.  A pair inside of that component connects nothing more, and every other pair has an end outside of it, so none that
    counts is missed.
    """
    work, h, n = Workspace(counts.sparkSession, "spanning"), counts.select("h"), counts.count()
    blocks, b = -(-n // block), F.col("block")
    if blocks <= LEAST_BLOCKS:
        return work.save(_all_tiles(h, ["h"], n, block).mapInArrow(_forest(low, high), "h long, other long"), "edges")
    ring = _tiles(_blocks(h, ["h"], blocks), ["h"], F.array(b, (b + 1) % blocks), F.array(b, (b + blocks - 1) % blocks), 2 * blocks)
    near = work.save(ring.mapInArrow(_forest(low, high), "h long, other long"), "near")
    linked = work.save(connected_components(near, "h", "other"), "linked")
    largest = linked.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = linked.join(F.broadcast(largest), "component").select(F.col("node").alias("h"))
    rest = work.save(h.join(inside, "h", "left_anti"), "rest")
    some, all_ = max(1, -(-rest.count() // BLOCK)), max(LEAST_BLOCKS, -(-n // BLOCK))
    # A pair of two signatures of the rest is met twice, and one with itself at no bits, which connects nothing.
    tiles = _tiles(_blocks(h, ["h"], all_), ["h"], F.sequence(F.lit(0), F.lit(all_ - 1)), F.sequence(F.lit(all_), F.lit(all_ + some - 1)), all_ * some, _blocks(rest, ["h"], some).withColumn("block", b + all_))
    far = work.save(tiles.mapInArrow(_forest(low, high), "h long, other long"), "far")
    return near.union(far)


def signature_links(counts: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Rows ``(h, other, pairs, total, best)`` for signatures ``(h, n)``: of each tile, edges ``(h, other)`` that connect what its pairs connect, and
    the number of pairs of rows that ``h`` is the first of, the sum of their distances and the least; no pair is kept."""

    def found(left, right, same):
        (x, n_x), (y, n_y) = ((_unsigned(side[0]), side[1].to_numpy(zero_copy_only=False)) for side in (left, right))
        label, shift = np.arange(len(x) if same else len(x) + len(y)), 0 if same else len(x)
        pairs, total, best = np.zeros(len(label), np.int64), np.zeros(len(label), np.int64), np.full(len(label), 127, np.int64)
        for i, j, d in _near(x, y, 0, threshold, same):
            label = _joined(label, i, j + shift)
            weight = n_x[i] * n_y[j]
            np.add.at(pairs, i, weight)
            np.add.at(total, i, weight * d)
            np.minimum.at(best, i, d)
        h = (x if same else np.concatenate([x, y])).view(np.int64)
        known = np.flatnonzero((label != np.arange(len(label))) | (pairs > 0))
        yield h[known], h[label[known]], pairs[known], total[known], best[known].astype(np.int32)

    tiles = _all_tiles(counts.select("h", "n"), ["h", "n"], counts.count(), block)
    links = tiles.mapInArrow(_compared(found, ["h", "other", "pairs", "total", "best"]), "h long, other long, pairs long, total long, best int")
    return Workspace(counts.sparkSession, "links").save(links, "rows")


def _spread(entries: DataFrame, probes: DataFrame, by: str = "h_b") -> tuple[DataFrame, DataFrame]:
    """Adds ``part`` to both sides: a frequent value's entries are dealt to several parts by ``by``, its lookups go to each."""
    many = entries.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
    many = many.select("band", "value", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts"))
    if not many.take(1):
        return entries.withColumn("part", F.lit(0)), probes.withColumn("part", F.lit(0))
    parts = F.coalesce("parts", F.lit(1))
    left = entries.join(many, ["band", "value"], "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    right = probes.join(many, ["band", "value"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left, right


def lookup_pairs(distinct: DataFrame, layout: Layout, threshold: int) -> DataFrame:
    """Pairs ``(h_a, h_b, distance)`` by looking every signature's bands up at all values within their radius."""
    value = lambda i: S.band(F.col("h"), i, layout[i][0], layout[i][1])
    entries = distinct.select(F.col("h").alias("h_b"), F.explode(F.array(*[F.struct(F.lit(i).alias("band"), value(i).alias("value")) for i in range(len(layout))])).alias("e")).select("e.band", "e.value", "h_b")

    def lookups(i: int) -> Column:
        _, width, radius = layout[i]
        flips = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]
        signed = F.expr("array(" + ",".join(f"cast({f - (1 << 64) if f >> 63 else f} as bigint)" for f in flips) + ")")
        return F.transform(signed, lambda flip: F.struct(F.lit(i).alias("band"), value(i).bitwiseXOR(flip).alias("value")))

    probes = distinct.select(F.col("h").alias("h_a"), F.explode(F.concat(*map(lookups, range(len(layout))))).alias("e")).select("e.band", "e.value", "h_a")
    entries, probes = _spread(entries, probes)
    x = F.col("h_a").bitwiseXOR(F.col("h_b"))
    joined = probes.join(entries, ["band", "value", "part"]).filter("h_a < h_b").withColumn("distance", S.hamming(F.col("h_a"), F.col("h_b")).cast("int")).filter(F.col("distance") <= threshold)
    # A pair counts in the first band that finds it, so no pair comes twice and none need be grouped.
    first = F.coalesce(*[F.when(F.bit_count(S.band(x, i, start, width)) <= radius, F.lit(i)) for i, (start, width, radius) in enumerate(layout)])
    return joined.filter(F.col("band") == first).select("h_a", "h_b", "distance")


def band_pairs(rows: DataFrame, threshold: int, bands: int = 4, min_matching: int = 1) -> DataFrame:
    """Verified pairs ``(a, b, distance)``, ``a < b``, of rows ``(id, h)`` that share ``min_matching`` bands or more.

    A pair counts in the first band that it shares, so pairs are not grouped; frequent values are dealt to several parts.
    """
    layout = S.band_layout(bands)
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), S.band(F.col("h"), i, start, width).alias("value")) for i, (start, width) in enumerate(layout)]))
    side = lambda x: rows.select(F.col("id").alias(x), F.col("h").alias(f"h_{x}"), entries.alias("e")).select("e.band", "e.value", x, f"h_{x}")
    right, left = _spread(side("b"), side("a"), "b")
    x = F.col("h_a").bitwiseXOR(F.col("h_b"))
    shared = [S.band(x, i, start, width) == 0 for i, (start, width) in enumerate(layout)]
    near = left.join(right, ["band", "value", "part"]).filter("a < b").withColumn("distance", S.hamming(F.col("h_a"), F.col("h_b")).cast("int")).filter(F.col("distance") <= threshold)
    once = near.filter(F.col("band") == F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(shared)]))
    if min_matching > 1:
        once = once.filter(sum((s.cast("int") for s in shared[1:]), shared[0].cast("int")) >= min_matching)
    return once.select("a", "b", "distance")


def signature_pairs(distinct: DataFrame, threshold: int, candidates: str = "exact", bands: int = 4, min_matching: int = 1) -> DataFrame:
    """Verified pairs ``(h_a, h_b, distance)`` of different signatures."""
    check_threshold(threshold)
    if candidates in ("exact", "auto"):
        hashes = distinct.select("h")
        n = hashes.count()
        layout = choose_plan(hashes, n, threshold)
        return product_pairs(hashes, threshold, n) if layout is None else lookup_pairs(hashes, layout, threshold)
    if candidates != "lsh":
        raise ValueError("candidates must be 'exact', 'auto' or 'lsh'")
    return band_pairs(distinct.select(F.col("h").alias("id"), "h"), threshold, bands, min_matching).withColumnsRenamed({"a": "h_a", "b": "h_b"})


def weighted_pairs(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD, **options) -> DataFrame:
    """Pairs of signatures ``(first_a, first_b, distance, pairs)``: the smallest row of each and how many pairs of rows they
    stand for.  Copies of one signature are one row with ``first_a = first_b``, so no row pairs are made."""
    counts = rows.filter("id IS NOT NULL AND h IS NOT NULL").groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    near = signature_pairs(counts.select("h"), threshold, **options)
    side = lambda x: counts.select(F.col("h").alias(f"h_{x}"), F.col("first").alias(f"first_{x}"), F.col("n").alias(f"n_{x}"))
    different = near.join(side("a"), "h_a").join(side("b"), "h_b").select("first_a", "first_b", "distance", (F.col("n_a") * F.col("n_b")).alias("pairs"))
    return different.union(counts.filter("n > 1").select("first", "first", F.lit(0), F.expr("n * (n - 1) div 2")))


def similar_pairs(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD, candidates: str = "exact", bands: int = 4, min_matching: int = 1, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pairs ``(a, b, distance)``, ``a < b``, of rows ``(id, h)`` within the threshold.

    Rows with a null id or signature take part in no pair.  ``carried`` columns, of numbers that are not null, come along as
    ``<column>_a`` and ``<column>_b`` (not with ``lsh``), so pairs need not be joined with the rows again.
    """
    check_threshold(threshold)
    known = rows.filter("id IS NOT NULL AND h IS NOT NULL").select("id", "h", *carried)
    if candidates == "lsh":
        if carried:
            raise ValueError("carried columns need exact candidates")
        return band_pairs(known, threshold, bands, min_matching)
    if candidates not in ("exact", "auto"):
        raise ValueError("candidates must be 'exact', 'auto' or 'lsh'")
    hashes, n = known.select("h").distinct(), known.count()
    different = hashes.count()
    if n <= COPIES * different and choose_plan(hashes, different, threshold) is None:
        return product_rows(known, threshold, n, carried)
    links = signature_pairs(hashes, threshold, candidates, bands, min_matching)
    a, b = (known.select(F.col("id").alias(i), F.col("h").alias(f"h_{side}"), *[F.col(c).alias(f"{c}_{i}") for c in carried]) for i, side in (("i", "a"), ("j", "b")))
    either = [F.when(F.col("i") < F.col("j"), F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{side}") for c in carried for side, x, y in (("a", "i", "j"), ("b", "j", "i"))]
    different = links.join(a, "h_a").join(b, "h_b").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance", *either)
    equal = a.join(b, F.col("h_a") == F.col("h_b")).filter("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("distance"), *either)
    return different.union(equal)


def matches(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD, classify: Callable[[Column], Column] = S.match_type, **options) -> DataFrame:
    """Pairs with ``distance``, ``similarity_percent`` and ``match_type``."""
    pairs = similar_pairs(rows, threshold, **options)
    return pairs.select("a", "b", "distance", S.similarity(F.col("distance")).alias("similarity_percent"), classify(F.col("distance")).alias("match_type"), *pairs.columns[3:])


def links(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD, **options) -> DataFrame:
    """Edges ``(a, b)`` that connect the same rows as the pairs: copies hang on their smallest id in place of all pairs."""
    known = rows.filter("id IS NOT NULL AND h IS NOT NULL").select("id", "h")
    first = known.groupBy("h").agg(F.min("id").alias("first"))
    near = signature_pairs(first.select("h"), threshold, **options)
    a, b = first.select(F.col("h").alias("h_a"), F.col("first").alias("a")), first.select(F.col("h").alias("h_b"), F.col("first").alias("b"))
    copies = known.join(first, "h").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return near.join(a, "h_a").join(b, "h_b").select("a", "b").union(copies)


def index_stats(rows: DataFrame, bands: int = 4) -> DataFrame:
    """One row on the band index over all rows: buckets, largest and mean bucket, pairs of each bucket, different candidate pairs,
    naive pairs, and how many times fewer the candidates are (the naive pairs where there are none)."""
    known = rows.filter("h IS NOT NULL").select("h")
    counts = known.groupBy("h").agg(F.count("*").alias("n"))
    if bands > SUBSET_BANDS:
        buckets = banded(known, bands).groupBy("band", "value").agg(F.count("*").alias("n"))
        side = lambda x: counts.select(F.col("h").alias(f"h_{x}"), F.col("n").alias(f"n_{x}"))
        different = candidate_pairs(counts.select("h"), bands).join(side("a"), "h_a").join(side("b"), "h_b").select((F.col("n_a") * F.col("n_b")).alias("pairs"))
        met = different.union(counts.select(F.expr("n * (n - 1) div 2"))).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("candidates"))
    else:
        # Pairs that agree on any band, by inclusion and exclusion of those that agree on all bands of a set: no pair is made.
        layout = S.band_layout(bands)
        sets = [s for k in range(1, bands + 1) for s in combinations(range(bands), k)]
        masks = [sum(((1 << layout[i][1]) - 1) << layout[i][0] for i in s) for s in sets]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        entries = F.array(*[F.struct(F.lit(i).alias("set"), F.col("h").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(signed)])
        grouped = counts.select("n", F.explode(entries).alias("e")).groupBy("e.set", "e.value").agg(F.sum("n").alias("n"))
        sign = F.element_at(F.array(*[F.lit(1 if len(s) % 2 else -1) for s in sets]), F.col("set") + 1)
        buckets = grouped.filter(F.col("set") < bands)
        met = grouped.agg(F.coalesce(F.sum(sign * F.expr("n * (n - 1) div 2")), F.lit(0)).alias("candidates"))
    total = buckets.agg(F.count("*").alias("buckets"), F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("bucket_pairs"))
    row = total.join(F.broadcast(met))  # one row each
    naive = F.expr(f"(entries div {bands}) * greatest(entries div {bands} - 1, 0) div 2")
    reduction = naive / F.greatest("candidates", F.lit(1))
    return row.select(F.lit(bands).alias("bands"), "buckets", "max_bucket", F.when(F.col("buckets") > 0, F.col("entries") / F.col("buckets")).otherwise(0.0).alias("avg_bucket"), "bucket_pairs", "candidates", naive.alias("naive_pairs"), reduction.alias("reduction"), F.expr(f"entries div {bands}").alias("rows"))


def fusion_votes(rows: DataFrame, pairs: DataFrame, threshold: int = DEFAULT_THRESHOLD, hashes: tuple[str, ...] = ("ahash", "dhash", "phash")) -> DataFrame:
    """Two-of-three voting over candidate pairs ``(a, b)``, which may carry the hashes: distances, votes, confidence and the least
    matching distance."""
    left, right = (rows.select(F.col("id").alias(side), *[F.col(h).alias(f"{h}_{side}") for h in hashes]) for side in ("a", "b"))
    carried = {f"{h}_{side}" for h in hashes for side in ("a", "b")} <= set(pairs.columns)
    joined = pairs if carried else pairs.select("a", "b").join(left, "a").join(right, "b")
    distance = {h: S.hamming(F.col(f"{h}_a"), F.col(f"{h}_b")).cast("int") for h in hashes}
    d = joined.select("a", "b", *[v.alias(f"{h}_distance") for h, v in distance.items()])
    within = [F.coalesce(F.col(f"{h}_distance") <= threshold, F.lit(False)) for h in hashes]
    votes = sum((w.cast("int") for w in within[1:]), within[0].cast("int"))
    voted = d.withColumn("votes", votes)
    confidence = F.when(F.col("votes") >= 3, "High").when(F.col("votes") == 2, "Medium").when(F.col("votes") == 1, "Low").otherwise("None")
    least = F.least(*[F.when(w, F.col(f"{h}_distance")) for w, h in zip(within, hashes, strict=True)])
    return voted.select("*", confidence.alias("confidence"), least.alias("min_distance"), (F.col("votes") >= 2).alias("is_duplicate"))

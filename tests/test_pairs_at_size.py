"""Similarity joins without what grows with the square of the input: against brute force on small rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signatures as S
from tessera.operators import groups as G
from tessera.operators import components, simjoin
from tessera.operators.components import connected_components

RND = random.Random(3)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def near(h, bits):
    for b in RND.sample(range(64), bits):
        h ^= 1 << b
    return h


def library(n=160):
    """Rows (id, h): clusters of copies and near copies around a few signatures, chains, and signatures alone."""
    centres = [RND.getrandbits(64) for _ in range(4)]
    rows = [near(RND.choice(centres), RND.choice((0, 0, 1, 3, 5, 8, 12))) for _ in range(n)]
    rows += [RND.getrandbits(64) for _ in range(20)]
    chain = [RND.getrandbits(64)]
    for _ in range(12):
        chain.append(near(chain[-1], 6))
    ids = RND.sample(range(1000), len(rows + chain))
    return list(zip(ids, map(signed, rows + chain), strict=True))


def brute(rows, low, high):
    both = [(min(x, y), max(x, y), bin((g ^ h) & (1 << 64) - 1).count("1")) for i, (x, g) in enumerate(rows) for y, h in rows[:i]]
    return {p for p in both if low <= p[2] <= high}


def groups_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {(find(x), x) for x in list(root)}


def frame(spark, rows):
    return spark.createDataFrame([*rows, (None, 5), (2000, None)], "id long, h long").repartition(3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_grids_are_counted_where_texts_are_read(spark):
    texts = [(1, "A b  a"), (2, None), (3, ""), (4, "Straße été " * 40)]
    df = S.token_grid(spark.createDataFrame(texts, "id long, text string"), "id", "text", 25)
    want = {}
    for i, text in texts:
        want[i] = [0] * 25
        for word in text.lower().split(" ") if text is not None else []:
            want[i][int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 25] += 1
    assert {r.id: r.grid for r in df.collect()} == want  # a null text has no words, but a row, as in the SQL
    assert "Exchange" not in plan_of(df)


@pytest.mark.parametrize("block", [20, 1000])
def test_products_of_rows_equal_brute_force(spark, block):
    rows = library()
    df = frame(spark, rows).dropna().withColumn("own", F.col("h"))
    got = simjoin.product_rows(df, 8, len(rows), ("own",), block).collect()
    h = dict(rows)
    assert len(got) == len(brute(rows, 0, 8)) and {(r.a, r.b, r.distance) for r in got} == brute(rows, 0, 8)
    assert all((r.own_a, r.own_b) == (h[r.a], h[r.b]) for r in got)
    assert "Join" not in plan_of(simjoin.similar_pairs(frame(spark, rows), 8))


@pytest.mark.parametrize("low, high", [(5, 15), (0, 8)])
@pytest.mark.parametrize("block", [10, 1000])
def test_spanning_edges_connect_what_all_pairs_connect(spark, low, high, block):
    rows = library()
    counts = simjoin.signature_counts(frame(spark, rows))
    edges = simjoin.spanning_edges(counts, low, high, block)
    h = [(x, x) for x in {x for _, x in rows}]
    got = {tuple(r) for r in connected_components(edges, "h", "other").select("component", "node").collect()}
    assert got == groups_of(brute(h, max(low, 1), high))


def test_stars_equal_brute_force(spark):
    rows = library()
    h, want = dict(rows), {(g, x) for g, x in groups_of(brute(rows, 5, 15)) if g != x}
    got = {(r.reference, r.member): r.distance for r in G.similar_stars(frame(spark, rows), 5, 15).collect()}
    assert got == {(g, x): bin((h[g] ^ h[x]) & (1 << 64) - 1).count("1") for g, x in want}


def test_groups_and_counts_without_pairs(spark):
    rows = library()
    df, pairs = frame(spark, rows), brute(rows, 0, 8)
    members, stats = G.signature_groups(df, 8)
    want = groups_of(pairs)
    assert sorted(map(tuple, members.collect())) == sorted(want)
    of = {x: g for g, x in want}
    for r in stats.collect():
        own = [d for a, _, d in pairs if of[a] == r.group_key]
        best = min(own)
        assert (r.pairs, r.match_type) == (len(own), "Exact" if best == 0 else "NearExact" if best <= 4 else "Similar")
        assert r.average_distance == pytest.approx(sum(own) / len(own))
    counted = {r.distance: r.pairs for r in simjoin.distance_counts(df, 12).collect()}
    found = [d for _, _, d in brute(rows, 0, 12)]
    assert counted == {d: found.count(d) for d in set(found)}


@pytest.mark.parametrize("bucket_rows", [5, 2000])
@pytest.mark.parametrize("min_matching", [1, 2])
def test_pairs_of_bands_equal_brute_force(spark, monkeypatch, bucket_rows, min_matching):
    monkeypatch.setattr(simjoin, "BUCKET_ROWS", bucket_rows)
    rows = library()
    h = dict(rows)
    shared = lambda a, b: sum(((h[a] ^ h[b]) >> (16 * i)) & 65535 == 0 for i in range(4))
    pairs = simjoin.similar_pairs(frame(spark, rows), 8, candidates="lsh", min_matching=min_matching)
    assert sorted(map(tuple, pairs.collect())) == sorted(p for p in brute(rows, 0, 8) if shared(*p[:2]) >= min_matching)


@pytest.mark.parametrize("bands", [4, 9])
def test_index_statistics_make_no_pairs(spark, bands):
    rows = library()
    layout = S.band_layout(bands)
    alike = lambda x: any((x >> start) & ((1 << width) - 1) == 0 for start, width in layout)
    candidates = sum(alike((g ^ h) & (1 << 64) - 1) for i, (_, g) in enumerate(rows) for _, h in rows[:i])
    df = simjoin.index_stats(frame(spark, rows).dropna(), bands)
    assert df.first().candidates == candidates and df.first().rows == len(rows)
    if bands == 4:
        assert "h_a" not in plan_of(df)


@pytest.mark.parametrize("low, high", [(0, 8), (0, 6), (5, 8)])
@pytest.mark.parametrize("candidates", [7, 500_000])
def test_looked_up_tiles_equal_compared_tiles(monkeypatch, low, high, candidates):
    monkeypatch.setattr(simjoin, "CANDIDATES", candidates)
    monkeypatch.setattr(simjoin, "HITS", 50)
    h = np.unique(np.array([x for _, x in library(300)], np.int64)).view(np.uint64)
    h = np.random.default_rng(1).permutation(h)
    layout = simjoin.probe_layout(high, simjoin.TILE_BANDS)
    for x, y, same in ((h, h, True), (h[:90], h[90:], False), (h[:1], h[1:2], False)):
        met = lambda found: sorted((*sorted((int(x[i]), int(y[j]))), int(d)) for part in found for i, j, d in zip(*part, strict=True))  # noqa: B023, E731
        assert met(simjoin._looked_up(x, y, low, high, same, layout)) == met(simjoin._hits(x, y, low, high, same))


def test_large_tiles_are_looked_up_unless_their_signatures_crowd():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) for _ in range(2))
    assert simjoin._tile_layout(x, y, 8) == simjoin.probe_layout(8, simjoin.TILE_BANDS)
    assert simjoin._tile_layout(x, y, 15) is None and simjoin._tile_layout(x[:50], y[:50], 8) is None
    assert simjoin._tile_layout(x & np.uint64(1023), y & np.uint64(1023), 8) is None


def test_few_edges_need_no_round(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a round was made")

    monkeypatch.setattr(components, "_dealt", never)
    edges = [(RND.randrange(300), RND.randrange(300)) for _ in range(200)] + [(None, 4), (9, 9)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {tuple(r) for r in connected_components(df, "a", "b").select("component", "node").collect()}
    assert got == groups_of([(a, b, 0) for a, b in edges if a is not None and a != b])

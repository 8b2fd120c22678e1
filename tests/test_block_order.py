"""Blocks of signatures whose rows stand in another order at each evaluation, as where several executors hand them on."""

import os
import random

import pyarrow as pa
import pytest

from tessera.operators import simjoin
from tessera.operators.components import connected_components
from tessera.plans import catalog, details  # noqa: F401  (both register into catalog)

from .test_pairs_at_size import brute, frame, groups_of, library

SF = "/root/testdata/sf0.01"


@pytest.fixture
def any_order(monkeypatch):
    gathered = simjoin._blocks

    def mixed(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                lists = {c: v for c, v in row.items() if isinstance(v, list)}
                order = list(range(len(next(iter(lists.values())))))
                random.SystemRandom().shuffle(order)
                row.update({c: [v[k] for k in order] for c, v in lists.items()})
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    def blocks(*args):
        packed = gathered(*args)
        return packed.mapInArrow(mixed, packed.schema)

    monkeypatch.setattr(simjoin, "_blocks", blocks)


@pytest.mark.parametrize("block", [20, 1000])
def test_pairs_of_blocks_in_any_order_equal_brute_force(spark, any_order, block):
    rows = library()
    df, want = frame(spark, rows).dropna(), brute(rows, 0, 8)
    pairs = simjoin.product_rows(df, 8, len(rows), (), block)
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    h = dict(rows)
    want = {(min(h[a], h[b]), max(h[a], h[b]), d) for a, b, d in want if d}
    assert sorted(map(tuple, simjoin.product_pairs(df.select("h").distinct(), 8, len(set(h.values())), block).collect())) == sorted(want)


def test_counts_and_components_of_blocks_in_any_order_equal_brute_force(spark, any_order):
    rows = library()
    df, pairs = frame(spark, rows), brute(rows, 0, 8)
    h, found = [(x, x) for x in {x for _, x in rows}], [d for _, _, d in pairs]
    assert {r.distance: r.pairs for r in simjoin.distance_counts(df, 8).collect()} == {d: found.count(d) for d in set(found)}
    counts = simjoin.signature_counts(df)
    links = simjoin.signature_links(counts, 8, 20)
    assert links.agg({"pairs": "sum"}).first()[0] == sum(d > 0 for d in found)
    for edges, low, high in ((links, 1, 8), (simjoin.spanning_edges(counts, 5, 15, 10), 5, 15)):
        got = {tuple(r) for r in connected_components(edges, "h", "other").select("component", "node").collect()}
        assert got == groups_of(brute(h, low, high))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["dup_pairs_exact", "explain_details", "explain_pair", "fusion_votes"])
def test_query_with_blocks_in_any_order_equals_sql(spark, same, any_order, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)

"""Connected components of an edge table by union-find inside of partitions.

A round deals every edge to both of its nodes, so a partition holds all edges of its nodes, and contracts what hangs together
there to stars around the smallest node.  That is one shuffle a round, and does at least what joining every node to its smallest
neighbour does; few rounds are needed, as each merges all that its partitions can see.  Before the rounds, edges are contracted where they
are, without a shuffle; if a forest of at most ``FEW_EDGES`` edges is left, one more contraction ends it and no round is needed.  A round that changes nothing ends it: then
every node has one edge, to the smallest node of its component.  A round's edges are written to the shared folder, so the plan
stays short and an executor may be lost at any time.  Only counters reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace
from ..workers import lean

#: Edges of one node that may go to one partition; a node with more is dealt to several.
HOT_DEGREE = 100_000
#: Edges that a task holds at once.
CHUNK = 500_000
#: So few edges are one chunk, as one task holds it anyway; more go through rounds.
FEW_EDGES = 200_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, in order, and the smallest node that each is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        one, two = label[x], label[y]
        if (one == two).all():
            return nodes, nodes[label]
        low = np.minimum(one, two)
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while not np.array_equal(shorter := label[label], label):
            label = shorter


def _contracted(chunk: int):
    """Stars of a partition's arcs ``(node, other)``, which are sorted by ``node``; at most ``chunk`` arcs and a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None

        def stars() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            nodes, lowest = contract(a, b)
            moved = nodes != lowest
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], kind), pa.array(lowest[moved], kind)], names=["u", "v"])
            # The last node may have more arcs in the next chunk, which so hang together with these.
            at = np.searchsorted(nodes, a[-1])
            held[:] = [(nodes[at : at + 1], lowest[at : at + 1])]

        for batch in batches:
            if batch.num_rows:
                kind = batch.column(0).type
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                size += batch.num_rows
                if size >= chunk:
                    yield from stars()
                    size = 0
        if size:
            yield from stars()

    return run


def _dealt(edges: DataFrame, count: int, hot_degree: int) -> DataFrame:
    """Arcs ``(node, other)``, all of a node in one partition; a node of over ``hot_degree`` edges is dealt to several, each of which
    also gets its smallest neighbour."""
    arcs = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
    if count > hot_degree:
        degrees = arcs.groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("low")).filter(F.col("n") > hot_degree)
        # Each has over hot_degree of the edges' ends, so they are few.
        hot = F.broadcast(degrees.select("node", "low", F.ceil(F.col("n") / hot_degree).cast("int").alias("parts")))
        own = F.pmod(F.xxhash64("other"), F.coalesce("parts", F.lit(1))).cast("int")
        salted = arcs.join(hot, "node", "left").select("node", "other", own.alias("part"))
        shared = hot.select("node", F.col("low").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return salted.unionByName(shared).repartition("node", "part").sortWithinPartitions("node").select("node", "other")
    return arcs.repartition("node").sortWithinPartitions("node")


def connected_components(edges: DataFrame, u: str, v: str, max_rounds: int = 60, hot_degree: int = HOT_DEGREE, chunk: int = CHUNK) -> DataFrame:
    """Rows ``(node, component)``: every endpoint of an edge, with the smallest node of its component.

    Self-loops and rows with a null endpoint add nothing; repeated edges are fine; without edges the result is empty.
    The node type is that of the two columns (they must agree and be orderable: numbers, strings or dates).
    """
    work = Workspace(edges.sparkSession, "components")
    clean = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    kind = clean.schema["u"].dataType.simpleString()
    stars = lambda arcs: arcs.mapInArrow(lean(_contracted(chunk)), f"u {kind}, v {kind}")
    current = work.save(stars(clean), "edges_0")
    fingerprint = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = current.agg(*fingerprint).first()
    if 0 < before[0] <= min(FEW_EDGES, chunk):
        current, before = work.save(stars(current.coalesce(1)), "edges_one"), (0,)
        work.drop("edges_0", release=False)
    for i in range(1, max_rounds + 1):
        if not before[0]:
            break
        current = work.save(stars(_dealt(current, before[0], hot_degree)).distinct(), f"edges_{i}")
        now = current.agg(*fingerprint).first()
        work.drop(f"edges_{i - 1}", release=False)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Near-duplicate groups of a stream: an index that is kept, and groups that grow and merge.

A batch's new signatures are looked up in the bands of all earlier ones, of which only the touched buckets are read, and compared
with one another.  The pairs that are found join the groups of their two sides: a group has a label, and a merge points the labels
of the merged groups to the smallest.  So a batch costs what its own rows and their partners cost, and what was grouped before is
not compared again.  After any number of batches the groups are those of one run over all rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..operators import simjoin
from ..operators.components import connected_components
from ..operators.keyed import KeyedStore
from ..tables import Workspace


class NearDuplicateStream:
    """Groups of rows ``(id, h)`` whose 64-bit signatures are linked by distances of ``threshold`` or less.

    The tables lie below ``path``: ``members`` (id and signature), ``bands`` (where a signature is found), ``labels`` (the group of a
    signature when it came) and ``merges`` (the label that a merged one points to now).  Rows carry the number of their batch, and a
    batch sees what earlier batches wrote, so one that runs again after a failure does the same once more.  Rows without an id or
    a signature are left out; the signature of an id should not change.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: int = simjoin.DEFAULT_THRESHOLD, bands: int = 4, buckets: int = 16, id_type: str = "long"):
        simjoin.check_threshold(threshold)
        self.spark, self.threshold = spark, threshold
        self.layout = simjoin.probe_layout(threshold, min(bands, threshold + 1))
        root = path.rstrip("/")
        self.members = KeyedStore(spark, f"{root}/members", f"id {id_type}, h long, batch long", ["id"], "batch", buckets)
        self.bands = KeyedStore(spark, f"{root}/bands", "band int, value long, h long, batch long", ["band", "value", "h"], "batch", buckets, bucket_by=["band", "value"])
        self.labels = KeyedStore(spark, f"{root}/labels", "h long, label long, batch long", ["h"], "batch", buckets)
        self.merges = KeyedStore(spark, f"{root}/merges", "label long, target long, batch long", ["label"], "batch", buckets)

    def _entries(self, distinct: DataFrame, probes: bool) -> DataFrame:
        """Rows ``(band, value, h)``: a signature's own values, or all values within the bands' radius."""

        def values(i: int, start: int, width: int, radius: int):
            own = S.band(F.col("h"), i, start, width)
            flips = [sum(1 << b for b in bits) for k in range(radius + 1 if probes else 1) for bits in combinations(range(width), k)]
            signed = F.array(*[F.lit(f - (1 << 64) if f >> 63 else f).cast("long") for f in flips])
            return F.transform(signed, lambda flip: F.struct(F.lit(i).alias("band"), own.bitwiseXOR(flip).alias("value")))

        every = F.concat(*[values(i, *x) for i, x in enumerate(self.layout)])
        return distinct.select("h", F.explode(every).alias("e")).select("e.band", "e.value", "h")

    def _current(self, labelled: DataFrame) -> DataFrame:
        """``(h, root)`` of rows ``(h, label)``: the label that each points to now."""
        merges = self.merges.in_buckets_of(labelled.select("label")).select("label", "target")
        return labelled.join(merges, "label", "left").select("h", F.coalesce("target", "label").alias("root"))

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch of rows ``(id, h)``; ``number`` rises from batch to batch."""
        work, stamp = Workspace(self.spark, "neardup"), F.lit(number).cast("long").alias("batch")
        rows = work.save(batch.filter("id IS NOT NULL AND h IS NOT NULL").select("id", "h"), "rows")
        fresh = rows.select("h").distinct()
        known = self.labels.lookup(fresh).filter(F.col("batch") < number).select("h")
        fresh = work.save(fresh.join(known, "h", "left_anti"), "fresh")
        self.members.upsert(rows.select("id", "h", stamp))
        if not fresh.take(1):
            return
        probes = work.save(self._entries(fresh, probes=True).withColumnRenamed("h", "h_a"), "probes")
        earlier = self.bands.in_buckets_of(probes).filter(F.col("batch") < number).select("band", "value", F.col("h").alias("h_b"))
        met = probes.join(earlier, ["band", "value"]).filter(S.hamming(F.col("h_a"), F.col("h_b")) <= self.threshold).select("h_a", "h_b").distinct()
        pairs = work.save(met.union(simjoin.signature_pairs(fresh, self.threshold).select("h_a", "h_b")), "pairs")
        # Every new signature begins as its own group; a pair joins the groups of its sides.
        old = self.labels.lookup(pairs.select(F.col("h_b").alias("h"))).filter(F.col("batch") < number).select("h", "label")
        roots = work.save(fresh.select("h", F.col("h").alias("root")).union(self._current(old)), "roots")
        side = lambda x: roots.select(F.col("h").alias(f"h_{x}"), F.col("root").alias(x))
        joined = connected_components(pairs.join(side("a"), "h_a").join(side("b"), "h_b"), "a", "b")
        moved = work.save(joined.filter("node <> component").select(F.col("node").alias("label"), F.col("component").alias("target")), "moved")
        # Labels that pointed to a group that has moved follow it; so one step always leads to the group.
        followers = self.merges.read().join(moved.select(F.col("label").alias("target"), F.col("target").alias("now")), "target").select("label", F.col("now").alias("target"))
        changed = work.save(moved.unionByName(followers).select("label", "target", stamp), "changed")
        self.labels.upsert(fresh.select("h", F.col("h").alias("label"), stamp))
        self.merges.upsert(changed)
        self.bands.upsert(self._entries(fresh, probes=False).select("band", "value", "h", stamp))

    def groups(self) -> DataFrame:
        """Rows ``(group_key, id)`` of all groups of two or more; the key is the smallest id of the group."""
        merges = self.merges.read().select("label", "target")
        labelled = self.labels.read().join(merges, "label", "left").select("h", F.coalesce("target", "label").alias("root"))
        named = self.members.read().select("id", "h").join(labelled, "h")
        keys = named.groupBy("root").agg(F.min("id").alias("group_key"), F.count("*").alias("n")).filter("n > 1")
        return named.join(keys, "root").select("group_key", "id")

    def run(self, stream: DataFrame, checkpoint: str):
        """Takes in all that a stream of rows ``(id, h)`` has, batch by batch; returns the query."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.add(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

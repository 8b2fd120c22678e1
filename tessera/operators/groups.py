"""Duplicate groups: members, representatives, statistics, keep rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import signatures as S
from ..tables import Workspace
from . import simjoin
from .components import connected_components


def members_of(edges: DataFrame) -> DataFrame:
    """Rows ``(group_key, id)`` of all endpoints; the key is the smallest id of the group."""
    return connected_components(edges, "a", "b").select(F.col("component").alias("group_key"), F.col("node").alias("id"))


def pair_stats(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Per group: the strongest class of its pairs and their mean distance."""
    keyed = matches.join(members.withColumnRenamed("id", "a"), "a")
    stats = keyed.groupBy("group_key").agg(F.sum("distance").alias("total"), F.count("*").alias("pairs"), F.min(S.match_ordinal(F.col("match_type"))).alias("best"))
    return stats.select("group_key", (F.col("total") / F.col("pairs")).alias("average_distance"), S.class_of_ordinal(F.col("best")).alias("match_type"), "pairs")


def signature_members(weighted: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(group_key, id)`` and statistics of the groups of :func:`simjoin.weighted_pairs`, without any pair of rows."""
    component = connected_components(weighted, "first_a", "first_b").withColumnRenamed("node", "first")
    key = F.coalesce("component", "first")
    linked = weighted.select(F.col("first_a").alias("first")).union(weighted.select("first_b")).distinct()
    known = rows.filter("id IS NOT NULL AND h IS NOT NULL").select("id", "h")
    named = known.groupBy("h").agg(F.min("id").alias("first")).join(linked, "first").join(component, "first", "left").select("h", key.alias("group_key"))
    members = known.join(named, "h").select("group_key", "id")
    keyed = weighted.join(component, weighted["first_a"] == component["first"], "left").withColumn("group_key", F.coalesce("component", "first_a"))
    stats = keyed.groupBy("group_key").agg(F.sum(F.col("distance") * F.col("pairs")).alias("total"), F.sum("pairs").alias("pairs"), F.min(S.match_ordinal(S.match_type(F.col("distance")))).alias("best"))
    return members, stats.select("group_key", (F.col("total") / F.col("pairs")).alias("average_distance"), S.class_of_ordinal(F.col("best")).alias("match_type"), "pairs")


def _named(counts: DataFrame, component: DataFrame, copies: bool) -> DataFrame:
    """Rows ``(h, n, group_key, ref)``: each signature of a component, or with copies if they count, the smallest row of its group and that
    row's signature."""
    linked = counts.join(component.withColumnRenamed("node", "h"), "h", "left").filter(F.col("component").isNotNull() | ((F.col("n") > 1) if copies else F.lit(False)))
    linked = linked.withColumn("component", F.coalesce("component", "h"))
    keys = linked.groupBy("component").agg(F.min(F.struct("first", "h")).alias("least"))
    named = linked.join(keys, "component").select("h", "n", F.col("least.first").alias("group_key"), F.col("least.h").alias("ref"))
    return Workspace(counts.sparkSession, "named").save(named, "rows")


def signature_groups(rows: DataFrame, threshold: int = simjoin.DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members and statistics as :func:`signature_members` gives them for :func:`simjoin.weighted_pairs`, with pairs counted where signatures are
    compared and only edges of a forest kept."""
    counts = simjoin.signature_counts(rows)
    links = simjoin.signature_links(counts, threshold)
    named = _named(counts, connected_components(links, "h", "other"), copies=True)
    members = rows.filter("id IS NOT NULL").select("id", "h").join(named, "h").select("group_key", "id")
    met = links.filter("pairs > 0").select("h", "pairs", "total", "best").union(named.filter("n > 1").select("h", F.expr("n * (n - 1) div 2"), F.lit(0).cast("long"), F.lit(0)))
    keyed = met.groupBy("h").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.min("best").alias("best")).join(named, "h")
    stats = keyed.groupBy("group_key").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"), F.min("best").alias("best"))
    return members, stats.select("group_key", (F.col("total") / F.col("pairs")).alias("average_distance"), S.match_type(F.col("best")).alias("match_type"), "pairs")


def similar_stars(rows: DataFrame, low: int, high: int) -> DataFrame:
    """The groups of rows ``(id, h)`` that pairs within ``low`` and ``high`` bits connect, as :func:`star_groups` scores them."""
    counts = simjoin.signature_counts(rows)
    named = _named(counts, connected_components(simjoin.spanning_edges(counts, low, high), "h", "other"), copies=low == 0)
    others = rows.filter("id IS NOT NULL").select("id", "h").join(named, "h").filter("id <> group_key")
    return _scored(others.select("group_key", F.col("id").alias("member"), F.col("h").alias("own"), "ref"))


def duplicate_groups(stats: DataFrame, files: DataFrame, members: DataFrame) -> DataFrame:
    """One row per group of two or more: size, representative (largest file, ties to the greatest id), class, mean
    distance and the bytes that its other members hold.  ``files`` has ``id`` and ``size``; ``stats`` are those of
    :func:`pair_stats` or :func:`signature_members`."""
    sized = members.join(files.select("id", F.coalesce("size", F.lit(0)).alias("bytes")), "id")
    grouped = sized.groupBy("group_key").agg(F.count("*").alias("size"), F.max(F.struct("bytes", "id")).alias("top"), F.sum("bytes").alias("all_bytes")).filter("size >= 2")
    rows = grouped.join(stats, "group_key")
    return rows.select("group_key", "size", F.col("top.id").alias("representative"), "match_type", "average_distance", (F.col("all_bytes") - F.col("top.bytes")).alias("duplicate_bytes"))


def group_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    joined = members.join(groups.select("group_key", "representative"), "group_key")
    return joined.select("group_key", "id", (F.col("id") == F.col("representative")).alias("is_representative"))


def summary(groups: DataFrame, files: DataFrame) -> DataFrame:
    """One row of totals, with the library's share and the remainder after clean-up."""
    totals = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("duplicate_bytes"), F.lit(0)).alias("savings_bytes"))
    library = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    row = library.join(F.broadcast(totals))  # one row each
    share = F.when(F.col("files") > 0, F.round(F.col("duplicates") * 100.0 / F.col("files"), 1)).otherwise(0.0)
    return row.select("files", "total_bytes", "groups", "duplicates", "savings_bytes", share.alias("duplicate_percent"), (F.col("files") - F.col("duplicates")).alias("remaining_files"), (F.col("total_bytes") - F.col("savings_bytes")).alias("remaining_bytes"))


def class_summary(weighted: DataFrame) -> DataFrame:
    """Pairs per class, from :func:`simjoin.weighted_pairs` or :func:`simjoin.distance_counts`."""
    return weighted.groupBy(S.match_type(F.col("distance")).alias("match_type")).agg(F.sum("pairs").alias("pairs"))


def star_groups(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """Each group scored against its reference (the smallest id): rows ``(reference, member, distance, ...)``."""
    h = hashes.select("id", "h")
    others = members.filter("id <> group_key").join(h, "id").select("group_key", F.col("id").alias("member"), F.col("h").alias("own"))
    return _scored(others.join(h.select(F.col("id").alias("group_key"), F.col("h").alias("ref")), "group_key"))


def _scored(others: DataFrame) -> DataFrame:
    scored = others.withColumn("distance", S.hamming(F.col("own"), F.col("ref")).cast("int"))
    return scored.select(F.col("group_key").alias("reference"), "member", "distance", S.similarity(F.col("distance")).alias("similarity_percent"), S.match_type(F.col("distance")).alias("match_type"))


def star_stats(stars: DataFrame, files: DataFrame) -> DataFrame:
    """Per reference: members, mean similarity, bytes of all, the reference's own included."""
    size = files.select("id", F.coalesce("size", F.lit(0)).alias("bytes"))
    own = stars.join(size.withColumnRenamed("id", "member"), "member").groupBy("reference").agg(F.count("*").alias("n"), F.sum("distance").alias("d"), F.sum("bytes").alias("b"))
    both = own.join(size.withColumnRenamed("id", "reference"), "reference")
    return both.select("reference", F.col("n").alias("members"), S.similarity(F.col("d") / F.col("n")).alias("average_similarity"), (F.col("b") + F.col("bytes")).alias("total_bytes"))


def _keep(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("keep", F.row_number().over(w) == 1)


def keep_strategy(rows: DataFrame, strategy: str, group: str = "group_key") -> DataFrame:
    """Adds ``keep``: true for the one row that its group keeps; ties keep the smallest ``pos``.

    ``rows`` has ``pos`` and what the strategy reads: ``is_representative``, ``overall``, ``path``, ``width``, ``height``,
    ``size``, ``modified``.  Groups where nothing is known keep their representative.
    """
    pos = F.col("pos").asc()
    area = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0)) if {"width", "height"} <= set(rows.columns) else None
    orders = {
        "duplicates": lambda: [F.col("is_representative").desc()],
        "sharpest": lambda: [F.col("overall").desc_nulls_last(), F.col("is_representative").desc()],
        "raw": lambda: [paths.extension(F.col("path")).isin(*paths.RAW_EXTENSIONS).desc(), F.col("is_representative").desc()],
        "most_metadata": lambda: [F.col("width").isNotNull().desc(), F.col("size").desc_nulls_last()],
        "highest_resolution": lambda: [area.desc()],
        "largest": lambda: [F.col("size").desc_nulls_last()],
        "oldest": lambda: [F.date_trunc("minute", "modified").asc_nulls_last()],
        "most_recent": lambda: [F.date_trunc("minute", "modified").desc_nulls_last()],
    }
    orders["composite"] = orders["sharpest"]
    if strategy == "raw":
        # Among several raw files the first one stays, whatever the representative.
        is_raw = paths.extension(F.col("path")).isin(*paths.RAW_EXTENSIONS)
        return _keep(rows, group, [is_raw.desc(), F.when(is_raw, F.lit(0)).otherwise(1 - F.col("is_representative").cast("int")).asc(), pos])
    return _keep(rows, group, [*orders[strategy](), pos])


def keeper_with_reason(rows: DataFrame, group: str, resolution: Column, size: Column, created: Column, path: Column) -> DataFrame:
    """The row each group keeps and why: a single highest resolution, else a file over a tenth larger than the next,
    else the oldest; the smallest path decides among equals."""
    r = rows.select(F.col(group).alias("g"), resolution.alias("r"), size.alias("s"), created.alias("c"), path.alias("p"))
    stats = r.groupBy("g").agg(
        F.max("r").alias("r1"), F.max("s").alias("s1"), F.max_by("p", F.struct("r", "p")).alias("by_r"), F.max_by("p", F.struct("s", "p")).alias("by_s"),
        F.min(F.struct(F.coalesce("c", F.lit("9999-12-31").cast("timestamp")), "p")).alias("oldest"), F.count("*").alias("n"),
    )
    near = r.join(stats.select("g", "r1", "s1"), "g").groupBy("g").agg(F.count(F.when(F.expr("r = r1"), 1)).alias("n_r"), F.count(F.when(F.expr("s = s1"), 1)).alias("n_s"), F.max(F.when(F.expr("s < s1"), F.col("s"))).alias("below"))
    both = stats.join(near, "g")
    second = F.when(F.col("n_s") > 1, F.col("s1")).otherwise(F.col("below"))
    larger = F.col("s1") > F.floor(second * 110 / 100)
    single = F.col("n") == 1
    reason = F.when(single, "OnlyOption").when(F.col("n_r") == 1, "HighestResolution").when(larger, "LargestFileSize").otherwise("OldestCreation")
    kept = F.when(single | (F.col("n_r") == 1), F.col("by_r")).when(larger, F.col("by_s")).otherwise(F.col("oldest.p"))
    return both.select(F.col("g").alias(group), kept.alias("kept"), reason.alias("reason"))

"""Totals and comparisons that a person sees beside the lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_total(rows: DataFrame, count: str = "files", size: str = "bytes") -> DataFrame:
    """One row: how many rows with a ``size`` column, and their sum (0 without rows)."""
    return rows.agg(F.count("*").alias(count), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias(size))


def selected_size(files: DataFrame, selected: DataFrame) -> DataFrame:
    """:func:`size_total` of the files whose id is selected."""
    return size_total(files.join(selected.select("id"), "id", "left_semi"))


def similar_totals(stars: DataFrame) -> DataFrame:
    """One row ``(groups, photos)`` of :func:`groups.star_groups`; the references count as photos."""
    per_group = stars.groupBy("reference").agg(F.count("*").alias("n"))
    return per_group.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).alias("photos"))


def share_estimate(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Rows ``(group_key, id, share)``: a duplicate's even share of its group's bytes, in whole bytes; 0 for the representative."""
    rows = members.join(groups.select("group_key", "size", "duplicate_bytes"), "group_key")
    even = F.expr("duplicate_bytes div greatest(size - 1, 1)")
    return rows.select("group_key", "id", F.when(F.col("is_representative"), F.lit(0)).otherwise(even).cast("long").alias("share"))


def _greater(a: Column, b: Column) -> Column:
    return F.when(a > b, "a").when(b > a, "b")


def compare_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with the side that has more bytes (``larger``) and more pixels (``sharper``); null where they are equal
    or one is unknown."""
    pixels = F.col("width").cast("long") * F.col("height")
    side = lambda x: files.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), pixels.alias(f"pixels_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", _greater(F.col("size_a"), F.col("size_b")).alias("larger"), _greater(F.col("pixels_a"), F.col("pixels_b")).alias("sharper"))

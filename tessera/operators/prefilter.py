"""Cheap filters before any signature is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(rows: DataFrame, key: Column | str, keep_null: bool = False) -> DataFrame:
    """Rows whose key another row has too.  Keys are counted first, so a frequent key is no hot task."""
    column = F.col(key) if isinstance(key, str) else key
    keyed = rows.withColumn("_key", column)
    twice = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_n")).filter("_n >= 2").select("_key")
    kept = keyed.join(twice, "_key", "left_semi").select(*rows.columns)
    return kept.unionByName(keyed.filter("_key IS NULL").select(*rows.columns)) if keep_null else kept


def same_size(files: DataFrame) -> DataFrame:
    return repeated(files, "size")


def same_prefix(files: DataFrame, content: Column, prefix: int = 4096) -> DataFrame:
    """Rows whose first bytes another row has; unreadable files (null content) stay."""
    return repeated(files, F.when(content.isNotNull(), F.xxhash64(F.substring(content, 1, prefix))), keep_null=True)


def prefilter(files: DataFrame, content: Column, mode: str = "off", least: int = 100, least_second: int = 50) -> DataFrame:
    """``mode='exact'``: size filter from ``least`` rows on, then the prefix filter beyond ``least_second``; 'off': all rows.

    Only byte-identical copies are sure to survive, so it is off unless asked for.
    """
    if mode == "off" or files.count() < least:
        return files
    by_size = same_size(files)
    return same_prefix(by_size, content) if by_size.count() > least_second else by_size


def skips(files: DataFrame, content: Column, prefix: int = 4096) -> DataFrame:
    """One row ``(skipped_by_size, skipped_by_prefix)``: how many files have a size of their own, and how many of the others have
    a beginning that no other of these has (unreadable files count as kept)."""
    begin = F.when(content.isNotNull(), F.xxhash64(F.substring(content, 1, prefix)))
    by_both = files.select("size", begin.alias("begin")).groupBy("size", "begin").agg(F.count("*").alias("n"))
    by_size = by_both.groupBy(F.col("size").alias("_size")).agg(F.sum("n").alias("of_size"))
    alone = F.col("size").isNull() | (F.col("of_size") < 2)
    marked = by_both.join(by_size, F.col("size").eqNullSafe(F.col("_size")))
    left = marked.withColumn("kept", F.when(alone, F.lit(0)).otherwise(F.col("n")))
    by_begin = left.groupBy("begin").agg(F.sum("kept").alias("kept"), F.sum("n").alias("n"))
    dropped = F.when(F.col("begin").isNotNull() & (F.col("kept") < 2), F.col("kept")).otherwise(F.lit(0))
    return by_begin.agg(F.coalesce(F.sum(F.col("n") - F.col("kept")), F.lit(0)).alias("skipped_by_size"), F.coalesce(F.sum(dropped), F.lit(0)).alias("skipped_by_prefix"))


def with_partner(hashes: DataFrame, hash_col: str, threshold: int) -> DataFrame:
    """Rows that have a partner at ``threshold`` or fewer bits; found by signatures, so no pairs of rows are made."""
    from .simjoin import signature_pairs

    counts = hashes.filter(F.col("id").isNotNull() & F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.count("*").alias("n"))
    near = signature_pairs(counts.select("h"), threshold)
    likely = counts.filter("n > 1").select("h").union(near.select("h_a")).union(near.select("h_b")).distinct()
    return hashes.filter("id IS NOT NULL").join(likely.select(F.col("h").alias(hash_col)), hash_col, "left_semi").select(*hashes.columns)


def two_phase(hashes: DataFrame, first: str, others: list[str], threshold: int) -> DataFrame:
    """The other signatures only for rows with a partner by the first one; null elsewhere."""
    likely = with_partner(hashes, first, threshold).select("id", F.lit(True).alias("_likely"))
    marked = hashes.join(likely, "id", "left")
    return marked.select("id", first, *[F.when(F.col("_likely"), F.col(c)).alias(c) for c in others])

"""Keyed tables kept as Parquet: the hash cache, the scan history, lifetime totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import KeyedStore, latest
from .running import GROUP_ROWS, Running, running

# ---------------------------------------------------------------- latest wins


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after the changes: for each key the row with the latest ``order``, changes first among equals."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, order, "_new").drop("_new")


# ---------------------------------------------------------------- hash cache


def seconds(t: Column) -> Column:
    """Whole epoch seconds, 0 before the epoch."""
    return F.greatest(F.unix_timestamp(t.cast("timestamp")), F.lit(0))


def cache_lookup(files: DataFrame, cache: DataFrame, by_algorithm: bool = True) -> DataFrame:
    """``files`` (path, size, modified, algorithm) with the cached ``hash``, null where none is valid.

    An entry is valid for the same size and the same modification time in whole seconds.  With ``by_algorithm`` only an entry of
    the same algorithm counts, else the latest one of the path.
    """
    on = ["path", "algorithm"] if by_algorithm else ["path"]
    entries = cache if by_algorithm else latest(cache, ["path"], "cached_at", "algorithm")
    entry = entries.select(*on, "hash", F.col("file_size").alias("_size"), F.col("file_modified").alias("_modified"))
    joined = files.join(entry, on, "left")
    valid = (F.col("size") == F.col("_size")) & (seconds(F.col("modified")) == seconds(F.col("_modified")))
    return joined.select(*files.columns, F.when(valid, F.col("hash")).alias("hash"))


def cache_prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file still exists."""
    return cache.join(files.select("path").distinct(), "path", "left_semi")


def pruned(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file is gone: what :func:`cache_prune` leaves out."""
    return cache.join(files.select("path").distinct(), "path", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("hash")), F.lit(0)).alias("bytes"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))


def cached(files: DataFrame, store: KeyedStore, by_algorithm: bool = True) -> DataFrame:
    """:func:`cache_lookup` in a stored cache, of which only the buckets of the files' keys are read."""
    return cache_lookup(files, store.in_buckets_of(files), by_algorithm)


# The stored columns.
CACHE_SCHEMA = "path string, algorithm string, hash binary, file_size long, file_modified timestamp, cached_at timestamp"
HISTORY_SCHEMA = "id string, module string, scan_time timestamp, duration_ms long, total_files long, groups long, duplicates long, savings_bytes long, status string, error string, settings string, paths array<string>"
STATE_SCHEMA = "directory string, last_scan timestamp, files long"
LIFETIME_SCHEMA = "name string, lifetime_bytes long, saved_at timestamp"


def hash_cache(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, CACHE_SCHEMA, ["path", "algorithm"], "cached_at", bucket_by=["path"])

def scan_history(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, HISTORY_SCHEMA, ["id"], "scan_time")


def scan_states(spark: SparkSession, path: str) -> KeyedStore:
    """The last scan of each directory."""
    return KeyedStore(spark, path, STATE_SCHEMA, ["directory"], "last_scan")


def lifetime_totals(spark: SparkSession, path: str) -> KeyedStore:
    """Lifetime totals by name; saving one replaces it."""
    return KeyedStore(spark, path, LIFETIME_SCHEMA, ["name"], "saved_at")


def history_point(history: DataFrame, key: object, id_col: str = "id") -> DataFrame:
    """The row of one id, or none."""
    return history.filter(F.col(id_col) == F.lit(key))


def history_page(history: DataFrame, limit: int = 50, offset: int = 0, time_col: str = "scan_time", id_col: str = "id") -> DataFrame:
    return history.orderBy(F.desc(time_col), id_col).offset(offset).limit(limit)


# ---------------------------------------------------------------- lifetime totals and milestones

#: Savings that are celebrated, in MB.
MILESTONES_MB = (100, 500, 1024, 5 * 1024, 10 * 1024, 25 * 1024, 50 * 1024, 100 * 1024)


def milestones_reached(total: Column, milestones: tuple[float, ...]) -> Column:
    """How many of the ascending milestones a running total has reached."""
    reached = F.lit(0)
    for m in milestones:
        reached = reached + (total >= m).cast("int")
    return reached


def milestones_passed(savings: DataFrame, key: str, order: str, amount: str, milestones: tuple[float, ...], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows ``(key, order, total, reached)`` of the savings with which a running total reaches a milestone."""
    total = running(savings.select(key, order, amount), [key], [order], Running(sums={"total": amount}), group_rows)
    counted = total.withColumn("reached", milestones_reached(F.col("total"), milestones)).withColumn("_before", milestones_reached(F.col("total") - F.col(amount), milestones))
    return counted.filter(F.col("reached") > F.col("_before")).select(key, order, "total", "reached")


def milestone_progress(total: Column, milestones: tuple[float, ...]) -> Column:
    """Percentage of the way from the last milestone to the next, 100 beyond the last."""
    progress = F.lit(100.0)
    for low, high in reversed(list(zip((0, *milestones), milestones, strict=False))):
        progress = F.when(total < high, F.least(F.lit(100.0), F.greatest(F.lit(0.0), (total - low) / F.lit(float(high - low)) * 100))).otherwise(progress)
    return progress


def parse_trash(lines: DataFrame) -> DataFrame:
    """Rows ``(filename, original_path, size, trashed_at)`` of 'name|path|size|epoch' lines; short lines are dropped."""
    parts = F.split("value", r"\|")
    number = lambda i: F.coalesce(parts.getItem(i).try_cast("long"), F.lit(0))
    return lines.filter(F.size(parts) >= 4).select(parts.getItem(0).alias("filename"), parts.getItem(1).alias("original_path"), number(2).alias("size"), number(3).alias("trashed_at"))


def lifetime_savings(lines: DataFrame) -> DataFrame:
    """One row ``bytes`` of the stored totals document; missing or unreadable gives 0."""
    parsed = F.from_json("value", "lifetime_bytes long", {"mode": "PERMISSIVE"})
    return lines.agg(F.coalesce(F.max(parsed["lifetime_bytes"]), F.lit(0)).alias("bytes"))

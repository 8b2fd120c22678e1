"""Streams of file changes: normalising, debouncing, latest state, incremental hashing and deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.running import GROUP_ROWS, Running, running
from ..sources import images


def new_files(spark: SparkSession, root: str, files_per_trigger: int = 500, content: bool = True) -> DataFrame:
    """A stream of the photos that appear below ``root``; paths are those of :func:`files.scan`."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(root)
    rows = stream.filter(paths.image_format(F.col("path")) != "Unknown")
    return rows.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def normalise(events: DataFrame) -> DataFrame:
    """Rows ``(path, kind, ts)`` of raw events ``(paths, kind, ts)``: one per path, photo files and known kinds only."""
    rows = events.select(F.explode("paths").alias("path"), F.lower("kind").alias("kind"), "ts")
    return rows.filter(F.col("kind").isin("create", "modify", "remove") & (paths.image_format(F.col("path")) != "Unknown"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows ``(path, kind)`` that lead from one listing ``(path, size, modified)`` to a later one: create, modify or remove.

    A file stream only sees new files; two listings, such as those of two micro-batches, show the rest.
    """
    old, new = (rows.groupBy("path").agg(F.max(F.struct("modified", "size")).alias(name)) for rows, name in ((before, "old"), (after, "new")))
    kind = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "modify")
    return old.join(new, "path", "full").select("path", kind.alias("kind")).filter("kind IS NOT NULL")


def debounce(events: DataFrame, key: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row per key and burst (no pause of ``gap`` or more): ``(key, start, events, kind)``, the kind of the last event.

    On a stream, events later than ``late`` are dropped and a burst comes out when it is over.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    bursts = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"), F.max_by("kind", F.struct("ts", "kind")).alias("kind"))
    return bursts.select(key, F.col("w.start").alias("start"), "events", "kind")


def latest_state(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key."""
    top = F.max(F.struct(*order, *[c for c in events.columns if c not in (*order, key)]))
    return events.groupBy(key).agg(top.alias("_t")).select(*[key if c == key else F.col(f"_t.{c}").alias(c) for c in events.columns])


def first_of_content(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of the first file of each content within the watermark."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    return hashed.withWatermark("modified", late).dropDuplicatesWithinWatermark(["content_hash"])


def picture_hashes(algorithm: str = "difference", side: int = 8) -> Callable[[DataFrame], DataFrame]:
    """For :func:`hash_into`: hashes of a batch's files by Spark's image source (JPEG, PNG, GIF, BMP).

    The batch's paths, at most as many as the stream's files per trigger, name what is read; a content column is not needed.
    """

    def hashed(batch: DataFrame) -> DataFrame:
        named = [r.path for r in batch.select("path").distinct().collect()]
        if not named:
            return images.hash_images(batch.select("path", F.lit(None).cast("binary").alias("content")), algorithm, side)
        return images.hash_images(images.read_images(batch.sparkSession, *map(images.literal_path, named)), algorithm, side)

    return hashed


def hash_into(files: DataFrame, hashed: Callable[[DataFrame], DataFrame], store, checkpoint: str):
    """Runs over all files that are there, batch by batch, and upserts each batch's hashes into ``store``; returns the query.

    ``hashed`` gives ``(path, algorithm, hash)`` of a batch, such as :func:`picture_hashes`.  Files without a hash are not stored, so
    they are tried again by whoever looks them up.  A batch that runs again writes the same rows.
    """

    def keep(batch: DataFrame, _: int) -> None:
        facts = batch.select("path", F.col("size").alias("file_size"), F.col("modified").alias("file_modified"))
        found = hashed(batch).filter("hash IS NOT NULL").select("path", "algorithm", "hash")
        store.upsert(found.join(facts, "path").select("path", "algorithm", "hash", "file_size", "file_modified", F.current_timestamp().alias("cached_at")))

    return files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watching(spark: SparkSession) -> list[str]:
    """Names of the running watches; stop one with :func:`unwatch`."""
    return [q.name for q in spark.streams.active if q.name]


def unwatch(spark: SparkSession, name: str) -> bool:
    for query in spark.streams.active:
        if query.name == name:
            query.stop()
            return True
    return False


def running_maximum(progress: DataFrame, key: str, order: str, value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Keeps the progress rows that exceed everything before them."""
    found = running(progress, [key], [order], Running(maxima={"_before": value}), group_rows)
    return found.filter(F.col("_before").isNull() | (F.col(value) > F.col("_before"))).drop("_before")

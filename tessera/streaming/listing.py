"""Change events of folders on a stream: what was created, modified or removed.

A file stream sees new files only.  Here every trigger lists the folders (in the executors, a task for each part of the tree), and
a stateful operator keeps the last sighting of every path: a path without one is created, another size or time is a modification,
and a path that was not seen for a while is removed, which a timer of its state finds.  Only paths that change give rows, and a
path's state is one row, however often it is seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import paths
from ..sources.files import _WalkReader

#: The state store that stateful processors with timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGHTING = "path string, size long, modified timestamp, seen timestamp"
CHANGE = "path string, kind string, size long, modified timestamp, at timestamp"


class _Listing(InputPartition):
    def __init__(self, part: InputPartition, seen: float):
        self.part, self.seen = part, seen


class _ListingReader(DataSourceStreamReader):
    """Offsets are moments; what lies between two of them is one listing, seen at the later one."""

    def __init__(self, roots: list[str], hidden: bool, pause: float):
        self.walk, self.pause, self.last = _WalkReader(roots, 1 << 30, hidden, False), pause, 0.0

    def initialOffset(self) -> dict:
        return {"seen": 0.0}

    def latestOffset(self) -> dict:
        now = time.time()
        if now - self.last >= self.pause:
            self.last = now
        return {"seen": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Listing(p, end["seen"]) for p in self.walk.partitions()] if end["seen"] > start["seen"] else []

    def read(self, partition: _Listing) -> Iterator[tuple]:
        seen = datetime.fromtimestamp(partition.seen, timezone.utc)
        for path, size, modified, error, _ in self.walk.read(partition.part):
            if error is None:
                yield path, size, modified, seen


class ListingSource(DataSource):
    """``spark.readStream.format('folder_listing')`` with options ``roots`` (newline-separated), ``include_hidden`` and ``pause``
    (seconds between listings at least)."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SIGHTING

    def streamReader(self, schema) -> DataSourceStreamReader:
        hidden = str(self.options.get("include_hidden", "false")).lower() == "true"
        return _ListingReader(self.options.get("roots", "").split("\n"), hidden, float(self.options.get("pause", 1)))


def sightings(spark: SparkSession, *roots: str, pause: float = 1.0, include_hidden: bool = False) -> DataFrame:
    """A stream of all photo files below the roots, again and again: ``(path, size, modified, seen)``."""
    spark.dataSource.register(ListingSource)
    rows = spark.readStream.format("folder_listing").option("roots", "\n".join(roots)).option("pause", pause).option("include_hidden", include_hidden).load()
    return rows.filter(paths.is_photo_name(F.col("path"), include_hidden=include_hidden))


class Paths(StatefulProcessor):
    """The last sighting of a path, and a timer that ends it."""

    def __init__(self, gone_after_ms: int):
        self.gone_after_ms = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "size long, modified timestamp, seen timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["seen", "modified", "size"])  # the sightings of one path in one batch
        last, events = self.last.get() if self.last.exists() else None, []
        for r in seen.itertuples(index=False):
            size = None if pd.isna(r.size) else int(r.size)
            if last is None:
                events.append((key[0], "create", size, r.modified, r.seen))
            elif pd.Timestamp(r.seen) < pd.Timestamp(last[2]):
                continue  # older than what is known
            elif (size, pd.Timestamp(r.modified)) != (last[0], pd.Timestamp(last[1])):
                events.append((key[0], "modify", size, r.modified, r.seen))
            last = (size, r.modified, r.seen)
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(last[2]).timestamp() * 1000) + self.gone_after_ms)
        yield self._frame(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield self._frame([(key[0], "remove", last[0], last[1], at)])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(events: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(events, columns=["path", "kind", "size", "modified", "at"])
        return frame.astype({"path": "object", "kind": "object"}).assign(size=frame["size"].astype("Int64"), modified=pd.to_datetime(frame["modified"]), at=pd.to_datetime(frame["at"]))


def change_events(seen: DataFrame, gone_after_ms: int = 5_000, late: str = "0 seconds") -> DataFrame:
    """Rows ``(path, kind, size, modified, at)`` of a stream of sightings ``(path, size, modified, seen)``.

    A path is removed once sightings of others are ``gone_after_ms`` (and ``late``) younger than its last one; so it should be more
    than the time between two listings.  If it is seen again later it is created anew.  Sightings later than ``late`` are dropped.
    The session needs ``spark.sql.streaming.stateStore.providerClass`` set to :data:`STATE_STORE`.
    """
    keyed = seen.filter("path IS NOT NULL").select("path", "size", F.col("modified").cast("timestamp").alias("modified"), F.col("seen").cast("timestamp").alias("seen")).withWatermark("seen", late)
    return keyed.groupBy("path").transformWithStateInPandas(Paths(gone_after_ms), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")

"""Keyed tables that several writers may change at once, and lookups that read only what they need.

A store is a folder with ``data``, where every change writes its rows into a folder of its own, and ``log``, one small file for
each change that counts.  A change counts from the moment its log file exists.  Log files are numbered without gaps and published
by an operation that fails where the number is taken (a hard link on a local disk, a rename without overwriting elsewhere), so
two writers never share a number; the one that comes second takes the next.  No change is based on what its writer has read:
upserts add rows, removals add the keys that are gone, and readers combine them in the order of the log.  So nothing is lost,
whatever the order.

Rows lie in buckets by a hash of their key.  A lookup of some keys reads the buckets of those keys alone.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a change does.
ROWS, GONE, WHOLE, CLEAR = "rows", "gone", "whole", "clear"


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the greatest by ``order``; counted by hash aggregation, so a frequent key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(*keys).agg(top.alias("_top")).select(*[c if c in keys else F.col(f"_top.{c}").alias(c) for c in rows.columns])


def _same(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


class Files:
    """The few operations on a shared file system that a log, or a report, needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.none_of = lambda kind: spark.sparkContext._gateway.new_array(kind, 0)
        self.system = self.path("").getFileSystem(self.conf)
        self.local = self.system.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(folder))) if self.system.exists(self.path(folder)) else []

    def there(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def age(self, name: str) -> float:
        return time.time() - self.system.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.system.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def size(self, name: str) -> int:
        return self.system.getFileStatus(self.path(name)).getLen()

    def rename(self, name: str, to: str) -> None:
        if not self.system.rename(self.path(name), self.path(to)):
            raise OSError(f"{name} could not be renamed to {to}")

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def publish(self, text: str, name: str) -> bool:
        """Makes the file ``name`` appear as a whole; False, without any change, if it is there already."""
        draft = f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}"
        self.write(draft, text)
        try:
            if self.local:
                place = lambda n: self.jvm.java.nio.file.Paths.get(self.path(n).toUri().getPath(), self.none_of(self.jvm.java.lang.String))
                self.jvm.java.nio.file.Files.createLink(place(name), place(draft))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
                context.rename(self.path(draft), self.path(name), self.none_of(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")))
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.delete(draft)
        return True


class KeyedStore:
    """A table of ``schema`` with one row for each value of ``keys``: the one with the greatest ``order``, the later change among
    equals.  Buckets are by the hash of ``bucket_by``, some or all of the keys.

    After ``most_changes`` changes the next writer also writes a whole version, in buckets anew; until then readers combine the
    last whole version with the changes since.  What the whole version before the last one stood for is deleted.
    """

    most_changes = 16

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str, buckets: int = 16, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.bucket_by = bucket_by or keys
        self.schema = spark.createDataFrame([], schema).schema
        self.files = Files(spark, self.path)

    # ------------------------------------------------------------ log

    def log(self) -> list[dict]:
        """The entries that count, in order.  A listing may miss a file that appears meanwhile, so gaps are looked up."""
        for again in range(10):
            listed = {int(n) for n in self.files.names("log") if n.isdigit()}
            gaps = [n for n in range(min(listed, default=0) + 1, max(listed, default=0)) if n not in listed]
            numbers = sorted(listed | {n for n in gaps if self.files.there(f"log/{n:010d}")})
            try:
                return [json.loads(self.files.read(f"log/{n:010d}")) | {"number": n} for n in numbers]
            except Py4JJavaError as problem:
                # Another writer has just deleted what a whole version stands for.
                if again == 9 or "FileNotFound" not in problem.java_exception.getClass().getName():
                    raise
        raise AssertionError

    def _commit(self, kind: str, data: str | None, covers: int = 0) -> int:
        entry = json.dumps({"kind": kind, "data": data, "buckets": self.buckets, "covers": covers})
        number = max((int(n) for n in self.files.names("log") if n.isdigit()), default=0) + 1
        while not self.files.publish(entry, f"log/{number:010d}"):
            number += 1
        return number

    def _current(self) -> tuple[list[dict], int]:
        """The entries to read, each with the place that it has in the order, and the last number that they stand for."""
        log = self.log()
        last = max((e["number"] for e in log), default=0)
        whole = max((e for e in log if e["kind"] == WHOLE), key=lambda e: (e["covers"], e["number"]), default=None)
        since = max([e["number"] for e in log if e["kind"] == CLEAR] + [0])
        if whole and whole["covers"] >= since:
            since = whole["covers"]
            entries = [whole | {"place": since}]
        else:
            entries = []
        return entries + [e | {"place": e["number"]} for e in log if e["kind"] in (ROWS, GONE) and e["number"] > since], last

    # ------------------------------------------------------------ buckets

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", self._bucket(self.buckets)).repartition(self.buckets, "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name

    def touched(self, keys: DataFrame, buckets: int | None = None) -> list[int]:
        """The buckets of some keys; there are ``buckets`` at most."""
        return sorted(r[0] for r in keys.select(self._bucket(buckets or self.buckets)).distinct().collect())

    def _table(self, entry: dict, wanted: dict[int, list[int]] | None) -> DataFrame:
        fields = [self.schema[k] for k in self.keys] if entry["kind"] == GONE else self.schema.fields
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        rows = self.spark.read.schema(f"{kinds}, _bucket int").parquet(f"{self.path}/data/{entry['data']}")
        if wanted is not None:
            rows = rows.filter(F.col("_bucket").isin(*wanted[entry["buckets"]]))
        return rows.drop("_bucket").withColumn("_place", F.lit(entry["place"]))

    def _combined(self, entries: list[dict], wanted: dict[int, list[int]] | None = None) -> DataFrame:
        parts = {kind: [self._table(e, wanted) for e in entries if (e["kind"] == GONE) == (kind == GONE)] for kind in (ROWS, GONE)}
        if not parts[ROWS]:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[ROWS][0]
        for more in parts[ROWS][1:]:
            rows = rows.unionByName(more)
        if parts[GONE]:
            gone = parts[GONE][0]
            for more in parts[GONE][1:]:
                gone = gone.unionByName(more)
            gone = gone.groupBy(*self.keys).agg(F.max("_place").alias("_until")).select(*[F.col(k).alias(f"_g_{k}") for k in self.keys], "_until")
            rows = rows.join(gone, _same(self.keys, "_g_") & (F.col("_place") < F.col("_until")), "left_anti")
        elif len(parts[ROWS]) == 1 and entries[0]["kind"] == WHOLE:
            return rows.drop("_place")
        return latest(rows, self.keys, self.order, "_place").drop("_place")

    # ------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        """All rows, as of now."""
        return self._combined(self._current()[0]).select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys (any columns beside the key columns are ignored).  Only their buckets are read."""
        wanted_keys = keys.select(*self.keys).distinct()
        entries = self._current()[0]
        wanted = {n: self.touched(wanted_keys, n) for n in {e["buckets"] for e in entries}}
        found = self._combined(entries, wanted)
        asked = wanted_keys.select(*[F.col(k).alias(f"_g_{k}") for k in self.keys])
        return found.join(asked, _same(self.keys, "_g_"), "left_semi").select(*self.schema.names)

    def in_buckets_of(self, rows: DataFrame) -> DataFrame:
        """The stored rows of all buckets of ``rows`` (which has the columns of ``bucket_by``), for a caller that joins them."""
        entries = self._current()[0]
        wanted = {n: self.touched(rows, n) for n in {e["buckets"] for e in entries}}
        return self._combined(entries, wanted).select(*self.schema.names)

    # ------------------------------------------------------------ writing

    def upsert(self, changes: DataFrame) -> int:
        """Adds rows; returns the number of the change."""
        number = self._commit(ROWS, self._write(latest(changes.select(*self.schema.names), self.keys, self.order)))
        self._tidy()
        return number

    def remove(self, keys: DataFrame) -> int:
        """Removes the rows of the given keys as they are when the change is written; returns how many were there just before."""
        gone = keys.select(*self.keys).distinct()
        n = self.lookup(gone).count()
        if n:
            self._commit(GONE, self._write(gone))
            self._tidy()
        return n

    def clear(self) -> int:
        """Removes everything; returns how many rows were there just before."""
        n = self.read().count()
        self._commit(CLEAR, None)
        return n

    def _tidy(self) -> None:
        if len(self._current()[0]) > self.most_changes:
            self.compact()

    def compact(self, buckets: int | None = None) -> None:
        """Writes a whole version of what is there now, with another number of buckets if one is given.  Changes that others
        write meanwhile have later numbers, so they stay."""
        entries, last = self._current()
        self.buckets = buckets or self.buckets
        self._commit(WHOLE, self._write(self._combined(entries).select(*self.schema.names)), covers=last)
        self._forget()

    def _forget(self) -> None:
        """Deletes what the whole version before the last one stands for; a reader that has the last one open keeps its files."""
        log = self.log()
        wholes = sorted((e for e in log if e["kind"] == WHOLE), key=lambda e: (e["covers"], e["number"]))
        if len(wholes) < 2:
            return
        kept = wholes[-2]
        for e in log:
            older = e["covers"] < kept["covers"] if e["kind"] == WHOLE else e["number"] <= kept["covers"]
            if older and e["number"] != log[-1]["number"]:
                self.files.delete(f"log/{e['number']:010d}")
                if e["data"]:
                    self.files.delete(f"data/{e['data']}")

    def vacuum(self, seconds: float = 86_400) -> int:
        """Deletes data of changes that never came to count, once they are ``seconds`` old; returns how many."""
        known = {e["data"] for e in self.log()}
        lost = [n for n in self.files.names("data") if n not in known and self.files.age(f"data/{n}") >= seconds]
        for name in lost:
            self.files.delete(f"data/{name}")
        return len(lost)

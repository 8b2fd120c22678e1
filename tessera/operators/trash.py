"""Moving files to the trash and back, as a table of actions.

A request names a file and an action (``trash`` or ``restore``) and has an id and a place in the order.  :func:`resolve` turns
requests into actions with a status, against the files that exist and the log of earlier actions; a request that the log knows is
not done twice, so a replay adds nothing.  :func:`execute` moves the files (in the executors, each move repeatable),
:func:`record` writes the log, and :func:`evict` takes what went out of the hash cache.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..tables import Workspace
from .keyed import KeyedStore
from .running import Running, running

TRASH, RESTORE = "trash", "restore"
#: Statuses: to be done, done, undone by a later restore, and refused or failed with an error.
PLANNED, DONE, RESTORED, FAILED = "planned", "done", "restored", "failed"
LOG_SCHEMA = "request_id string, path string, action string, status string, error string, seq long, saved_at timestamp"


def action_log(spark: SparkSession, path: str) -> KeyedStore:
    """One row for each request; a later state of it replaces the earlier one."""
    return KeyedStore(spark, path, LOG_SCHEMA, ["request_id"], "saved_at")


def state(log: DataFrame) -> DataFrame:
    """Rows ``(path, action, seq)``: the last action of each path that is planned or done."""
    standing = log.filter(F.col("status").isin(PLANNED, DONE, RESTORED))
    last = standing.groupBy("path").agg(F.max(F.struct("seq", "request_id", "action")).alias("last"))
    return last.select("path", F.col("last.action").alias("action"), F.col("last.seq").alias("seq"))


def resolve(requests: DataFrame, files: DataFrame, log: DataFrame | None = None, group_rows: int = 100_000) -> DataFrame:
    """Rows ``(request_id, path, action, status, error, seq)`` of the requests that ``log`` does not know.

    ``requests`` has ``request_id, path, action, seq``; equal ids are one request (the smallest ``seq`` counts).  Requests of a
    path act one after another by ``(seq, request_id)``, after what the log says of the path.  A file can be trashed if it exists
    and is not in the trash, and restored if it is there; a name that is not safe is never restored and changes nothing.  Null
    paths and unknown actions fail.  Frequent paths are spread over several tasks.
    """
    fresh = requests.groupBy("request_id").agg(F.min(F.struct("seq", "path", "action")).alias("r")).select("request_id", "r.path", "r.action", "r.seq")
    if log is not None:
        fresh = fresh.join(log.select("request_id").distinct(), "request_id", "left_anti")
    known = files.select("path").distinct().withColumn("_there", F.lit(True))
    named = fresh.join(known, "path", "left")
    error = (
        F.when(F.col("path").isNull(), "No path")
        .when(~F.coalesce(F.col("action").isin(TRASH, RESTORE), F.lit(False)), "Unknown action")
        .when((F.col("action") == RESTORE) & ~paths.is_safe_name(paths.file_name(F.col("path"))), "Invalid filename (contains unsafe characters)")
        .when((F.col("action") == TRASH) & F.col("_there").isNull(), "File not found")
    )
    work = Workspace(requests.sparkSession, "trash")
    judged = work.save(named.withColumn("error", error).drop("_there"), "judged")
    # A file that is in the trash already need not exist where it was.
    acting = judged.filter("error IS NULL OR error = 'File not found'").select("request_id", "path", "action", "seq", "error", F.lit(1).alias("_new"))
    if log is not None:
        before = state(log).select(F.lit(None).cast("string").alias("request_id"), "path", "action", "seq", F.lit(None).cast("string").alias("error"), F.lit(0).alias("_new"))
        acting = acting.unionByName(before.join(acting.select("path").distinct(), "path", "left_semi"))
    # A file that is not there can be in the trash only by the log; its failing requests change nothing, so they are set aside.
    trashed_by_log = acting.filter("_new = 0 AND action = 'trash'").select("path", F.lit(True).alias("_in_trash"))
    acting = acting.join(trashed_by_log, "path", "left") if log is not None else acting.withColumn("_in_trash", F.lit(None).cast("boolean"))
    acting = work.save(acting, "acting")
    gone = F.col("error").isNotNull() & F.col("_in_trash").isNull()
    after = running(acting.filter(~gone | (F.col("_new") == 0)), ["path"], ["_new", "seq", "request_id"], Running(previous={"_before": "action"}), group_rows)
    why = (
        F.when((F.col("action") == TRASH) & F.col("_before").eqNullSafe(F.lit(TRASH)), "Already in trash")
        .when((F.col("action") == RESTORE) & ~F.col("_before").eqNullSafe(F.lit(TRASH)), "Not found in trash")
    )
    done = after.filter("_new = 1").select("request_id", "path", "action", "seq", why.alias("error"))
    failed = judged.filter("error IS NOT NULL AND error <> 'File not found'").select("request_id", "path", "action", "seq", "error")
    failed = failed.unionByName(acting.filter(gone & (F.col("_new") == 1)).select("request_id", "path", "action", "seq", "error"))
    every = done.unionByName(failed)
    return every.select("request_id", "path", "action", F.when(F.col("error").isNull(), PLANNED).otherwise(FAILED).alias("status"), "error", "seq")


def _moved(source: str, target: str) -> str | None:
    """Moves a file once: doing it again after it was done is fine; an error text otherwise."""
    if not os.path.lexists(source):
        return None if os.path.lexists(target) else "File not found"
    if os.path.lexists(target):
        return "There is a file already"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    os.rename(source, target)
    return None


def execute(actions: DataFrame, trash_root: str, dry_run: bool = True) -> DataFrame:
    """The actions with what became of them: planned ones become ``done`` or ``failed``; under ``dry_run`` nothing is touched.

    A file lies in the trash under ``trash_root`` (on the file system of the files, which all executors see) by a hash of its
    path.  Of several planned actions of a path only the last one moves it, the ones before are ``restored`` or ``done`` with it.
    """
    if dry_run:
        return actions
    planned = actions.filter(F.col("status") == PLANNED)
    last = planned.groupBy("path").agg(F.max(F.struct("seq", "request_id")).alias("_last"), F.min(F.struct("seq", "request_id", "action")).alias("_first"))
    marked = planned.join(last, "path").withColumn("_moves", F.struct("seq", "request_id") == F.col("_last"))
    # Where the last action undoes the first one, the file is where it should be.
    marked = marked.withColumn("_stays", F.col("_moves") & (F.col("action") != F.col("_first.action")))
    shelf = F.concat(F.lit(trash_root.rstrip("/") + "/"), F.substring(F.sha2("path", 256), 1, 32), F.lit("/"), paths.file_name(F.col("path")))
    rows = marked.withColumn("_shelf", shelf).select("request_id", "path", "action", "seq", "_moves", "_stays", "_shelf")

    def act(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = []
            for r in frame.itertuples(index=False):
                path, action, moves, stays, shelf = r[1], r[2], r[4], r[5], r[6]
                try:
                    errors.append(None if not moves or stays else _moved(path, shelf) if action == TRASH else _moved(shelf, path))
                except OSError as problem:
                    errors.append(str(problem))
            yield frame[["request_id", "path", "action", "seq"]].assign(error=errors)

    tried = rows.mapInPandas(act, "request_id string, path string, action string, seq long, error string")
    status = F.when(F.col("error").isNotNull(), FAILED).when(F.col("action") == RESTORE, RESTORED).otherwise(DONE)
    outcome = tried.select("request_id", "path", "action", status.alias("status"), "error", "seq")
    return outcome.unionByName(actions.filter(F.col("status") != PLANNED).select(*outcome.columns))


def record(log: KeyedStore, actions: DataFrame) -> int:
    """Writes the actions to the log; returns the number of the change.  Actions that are there already are replaced by themselves."""
    return log.upsert(actions.select("request_id", "path", "action", "status", "error", "seq", F.current_timestamp().alias("saved_at")))


def run(requests: DataFrame, files: DataFrame, log: KeyedStore, trash_root: str) -> DataFrame:
    """Resolves, logs and executes the requests; returns one row of :func:`outcome` for what was open.

    Planned actions are logged before anything is moved.  So a run that was cut off leaves them planned, the next run does them
    with its own, and running the same requests again changes nothing.
    """
    record(log, resolve(requests, files, log.read()))
    # The rows that are read now stay readable when the log goes on.
    todo = Workspace(files.sparkSession, "trash").save(log.read().filter(F.col("status") == PLANNED).drop("saved_at"), "todo")
    done = Workspace(files.sparkSession, "trash").save(execute(todo, trash_root, dry_run=False), "done")
    record(log, done)
    return outcome(done)


def in_trash(log: DataFrame) -> DataFrame:
    """Rows ``(path, seq)`` of the files that are in the trash by the log."""
    return state(log).filter(F.col("action") == TRASH).select("path", "seq")


def evict(cache: DataFrame, log: DataFrame) -> DataFrame:
    """The cache without the entries of files in the trash."""
    return cache.join(in_trash(log).select("path"), "path", "left_anti")


def evict_from(store: KeyedStore, log: DataFrame) -> int:
    """Removes the entries of files in the trash from a stored cache; returns how many there were."""
    gone = in_trash(log).select("path")
    return store.remove(store.in_buckets_of(gone).join(gone, "path", "left_semi").select(*store.keys))


def outcome(actions: DataFrame) -> DataFrame:
    """One row ``(trashed, restored, failed)`` of how many actions are done or planned, and how many failed."""
    ok = F.col("status") != FAILED
    return actions.agg(F.count_if(ok & (F.col("action") == TRASH)).alias("trashed"), F.count_if(ok & (F.col("action") == RESTORE)).alias("restored"), F.count_if(~ok).alias("failed"))

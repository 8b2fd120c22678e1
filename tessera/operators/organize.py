"""Date-based reorganisation: destination folders, conflict numbers, roll-ups and execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, wording
from ..tables import Workspace
from .running import GROUP_ROWS, Running, running

FOLDERS = {"year_month": "yyyy/MM' - 'MMMM", "year_month_day": "yyyy/MM/dd", "flat": "yyyy-MM"}


def folder(date: Column, structure: str = "year_month") -> Column:
    return F.coalesce(F.date_format(date, FOLDERS[structure]), F.lit("Unsorted"))


def _numbered(name: Column, n: Column) -> Column:
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.when(n == 0, name).otherwise(F.concat(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"), F.lit("_"), n.cast("string"), ext))


def plan(files: DataFrame, structure: str = "year_month", max_rounds: int = 100, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows ``(source, date, size, folder, destination, has_conflict)`` for ``files`` with ``source, name, date, size``.

    Files that want one destination are numbered in the order of their sources.  A numbered name that is some file's own
    natural name moves on by the block of numbers already tried, until no two destinations agree; if they still do after
    ``max_rounds`` rounds, that is an error.  Files already on disk are not looked at.  A destination that more than ``group_rows``
    files want is numbered by several tasks.
    """
    rows = files.select("source", "name", "date", "size", folder(F.col("date"), structure).alias("folder"))
    ranked = running(rows, ["folder", "name"], ["source"], Running(number="_n"), group_rows).withColumn("_n", F.col("_n") - 1)
    sized = ranked.groupBy("folder", "name").agg(F.count("*").alias("_many"))
    naturals = ranked.filter("_n = 0").select("folder", F.col("name").alias("_taken"))
    placed = ranked.withColumn("_name", _numbered(F.col("name"), F.col("_n")))
    work = Workspace(files.sparkSession, "plan")
    for i in range(max_rounds):
        clash = placed.filter("_n > 0").join(naturals, (placed["folder"] == naturals["folder"]) & (placed["_name"] == naturals["_taken"]), "left_semi")
        if not clash.take(1):
            break
        jump = clash.select("folder", "name", "source").join(sized, ["folder", "name"]).select("source", "folder", "name", F.col("_many").alias("_jump"))
        placed = placed.join(jump, ["source", "folder", "name"], "left").withColumn("_n", F.col("_n") + F.coalesce("_jump", F.lit(0))).drop("_jump").withColumn("_name", _numbered(F.col("name"), F.col("_n")))
        placed = work.save(placed, f"round_{i}")
    else:
        raise RuntimeError(f"destinations still clash after {max_rounds} rounds")
    return placed.select("source", "date", "size", "folder", F.concat_ws("/", "folder", "_name").alias("destination"), (F.col("_n") > 0).alias("has_conflict"))


def dated_files(files: DataFrame) -> DataFrame:
    """``files`` (path, size, modified, and the EXIF texts exif_original and exif_changed, null where unknown) as the
    input of :func:`plan`: the date is that of the shot, else that of the EXIF change, else the day of the file's time."""
    shot, changed = (wording.lenient_date(F.col(c)) for c in ("exif_original", "exif_changed"))
    date = F.coalesce(shot, changed, F.to_date("modified"))
    media = files.filter(paths.has_extension(F.col("path"), paths.LIBRARY_EXTENSIONS))
    return media.select(F.col("path").alias("source"), paths.file_name(F.col("path")).alias("name"), date.alias("date"), "size")


def by_year(planned: DataFrame) -> DataFrame:
    dated = planned.filter("date IS NOT NULL")
    return dated.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("year"))


def date_range(planned: DataFrame) -> DataFrame:
    return planned.agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))


def counters(planned: DataFrame) -> DataFrame:
    return planned.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if("has_conflict").alias("conflicts"), F.countDistinct(paths.parent(F.col("destination"))).alias("folders"))


def execute(planned: DataFrame, root: str, move: bool = False, dry_run: bool = True) -> DataFrame:
    """Copies or moves the planned files under ``root``; rows ``(source, destination, status, error)``.

    Nothing is touched under ``dry_run``.  A copy is checked by its size before a moved source is removed.
    """
    if dry_run:
        return planned.select("source", "destination", F.lit("planned").alias("status"), F.lit(None).cast("string").alias("error"))

    def act(batches):
        import os
        import shutil

        for frame in batches:
            status, error = [], []
            for source, destination in zip(frame["source"], frame["destination"], strict=True):
                target = os.path.join(root, destination)
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    shutil.copy2(source, target)
                    if os.path.getsize(source) != os.path.getsize(target):
                        raise OSError("the copy's size differs")
                    if move:
                        os.remove(source)
                    status.append("done")
                    error.append(None)
                except OSError as problem:
                    status.append("failed")
                    error.append(str(problem))
            yield frame.assign(status=status, error=error)

    return planned.select("source", "destination").mapInPandas(act, "source string, destination string, status string, error string")

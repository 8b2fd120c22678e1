"""File metadata and file content as DataFrames.

``scan`` uses Spark's own binary-file source: fast, and without hidden names.  ``walk`` uses a Python data source
that lists every name, follows depth limits and reports what it could not read as rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths


def scan(spark: SparkSession, *roots: str, photos_only: bool = True, content: bool = False) -> DataFrame:
    """Rows ``(path, size, modified, format[, content])`` below the roots; overlapping roots give each file once.

    Without ``content`` the files are not opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    rows = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    rows = rows.filter(paths.is_photo_name(F.col("path"))) if photos_only else rows
    rows = rows.select("path", "size", "modified", paths.image_format(F.col("path")).alias("format"), *(["content"] if content else []))
    return rows.dropDuplicates(["path"]) if len(roots) > 1 else rows


class _Folder(InputPartition):
    def __init__(self, path: str, depth: int, whole: bool):
        self.path, self.depth, self.whole = path, depth, whole


def _leads_back(entry: os.DirEntry) -> bool:
    """Is the entry a link to a folder that it is in?"""
    if not entry.is_symlink():
        return False
    target, here = os.path.realpath(entry.path), os.path.realpath(os.path.dirname(entry.path))
    return os.path.commonpath([target, here]) == target


class _WalkReader(DataSourceReader):
    def __init__(self, roots: list[str], max_depth: int, hidden: bool, links: bool):
        self.roots, self.max_depth, self.hidden, self.links = roots, max_depth, hidden, links

    def _folders(self, folder: str) -> list[str]:
        try:
            return [e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=self.links) and not _leads_back(e)]
        except OSError:
            return []  # the folder's own partition reports it

    def partitions(self, enough: int = 64) -> list[InputPartition]:
        """The roots and their folders, level by level until there are enough, each by itself; the last level with all below it."""
        parts: list[InputPartition] = [_Folder(root, 0, False) for root in self.roots]
        level, depth = [f for root in self.roots if os.path.isdir(root) for f in self._folders(root)], 1
        while level and depth < self.max_depth:
            if len(parts) + len(level) >= enough or depth + 1 == self.max_depth:
                return parts + [_Folder(f, depth, True) for f in level]
            parts += [_Folder(f, depth, False) for f in level]
            level, depth = [f for folder in level for f in self._folders(folder)], depth + 1
        return parts

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not os.path.isdir(partition.path):
            yield (partition.path, None, None, "NotADirectory", "no such folder")
            return
        waiting = [(partition.path, partition.depth)]
        while waiting:
            folder, depth = waiting.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as problem:
                yield (folder, None, None, "PermissionDenied" if isinstance(problem, PermissionError) else "ReadDirectory", str(problem))
                continue
            for entry in entries:
                if entry.is_dir(follow_symlinks=self.links):
                    if _leads_back(entry):
                        yield (entry.path, None, None, "SymlinkCycle", "the link leads to a folder that it is in")
                    elif partition.whole and depth + 1 < self.max_depth:
                        waiting.append((entry.path, depth + 1))
                elif self.hidden or not entry.name.startswith("."):
                    try:
                        stat = entry.stat(follow_symlinks=self.links)
                        yield (entry.path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), None, None)
                    except OSError as problem:
                        yield (entry.path, None, None, "PermissionDenied" if isinstance(problem, PermissionError) else "ReadFile", str(problem))


class WalkSource(DataSource):
    """``spark.read.format('file_walk')`` with options ``roots`` (newline-separated), ``max_depth``, ``include_hidden``, ``follow_symlinks``."""

    @classmethod
    def name(cls) -> str:
        return "file_walk"

    def schema(self) -> str:
        return "path string, size long, modified timestamp, error string, message string"

    def reader(self, schema) -> DataSourceReader:
        yes = lambda key: str(self.options.get(key, "false")).lower() == "true"
        return _WalkReader(self.options.get("roots", "").split("\n"), int(self.options.get("max_depth", 1 << 30)), yes("include_hidden"), yes("follow_symlinks"))


def walk(spark: SparkSession, *roots: str, max_depth: int = 1 << 30, include_hidden: bool = False, follow_symlinks: bool = False, extensions: tuple[str, ...] | None = paths.PHOTO_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(files, errors) below the roots, hidden names included on request; ``extensions=None`` takes every file."""
    spark.dataSource.register(WalkSource)
    found = spark.read.format("file_walk").option("roots", "\n".join(roots)).option("max_depth", max_depth).option("include_hidden", include_hidden).option("follow_symlinks", follow_symlinks).load()
    files = found.filter("error IS NULL")
    if extensions is not None:
        files = files.filter(paths.is_photo_name(F.col("path"), extensions, include_hidden))
    files = files.select("path", "size", "modified", paths.image_format(F.col("path")).alias("format")).dropDuplicates(["path"])
    return files, found.filter("error IS NOT NULL").select(F.col("error").alias("kind"), "path", "message")


def large_file_candidates(spark: SparkSession, *roots: str, include_hidden: bool = False, extensions: tuple[str, ...] = paths.LARGE_FILE_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """:func:`walk` for the search of large files: a root that is missing or no folder is an error, not a row of errors."""
    for root in roots:
        if not os.path.exists(root):
            raise FileNotFoundError(f"no such folder: {root}")
        if not os.path.isdir(root):
            raise NotADirectoryError(f"not a folder: {root}")
    if not roots:
        raise ValueError("no folder was given")
    return walk(spark, *roots, include_hidden=include_hidden, extensions=extensions)


def file_info(files: DataFrame, metadata: DataFrame, path: str) -> DataFrame:
    """One row about a file, empty where it is unknown; times in UTC."""
    row = files.filter(F.col("path") == path).join(metadata.select("path", "width", "height"), "path", "left")
    return row.select("path", paths.file_name(F.col("path")).alias("filename"), "size", F.date_format("modified", "yyyy-MM-dd HH:mm").alias("modified"), "width", "height")

"""Largest files and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def large_files(files: DataFrame, min_size_mb: float = 10, k: int = 50, media_only: bool = True) -> DataFrame:
    """The ``k`` largest files of at least ``min_size_mb``, ties to the smaller path."""
    least = int(min_size_mb * 1024 * 1024)
    kept = files.filter((F.col("size") >= least) & (paths.has_extension(F.col("path"), paths.LARGE_FILE_EXTENSIONS) if media_only else F.lit(True)))
    top = kept.orderBy(F.desc("size"), "path").limit(k)
    return top.select("path", paths.file_name(F.col("path")).alias("filename"), F.col("size").alias("size_bytes"), paths.extension(F.col("path")).alias("file_type"), *(["modified"] if "modified" in files.columns else []))


def large_totals(files: DataFrame, min_size_mb: float = 10, media_only: bool = True) -> DataFrame:
    """Files seen, files that qualify and their bytes (all of them, not only the top ones)."""
    fits = (F.col("size") >= int(min_size_mb * 1024 * 1024)) & (paths.has_extension(F.col("path"), paths.LARGE_FILE_EXTENSIONS) if media_only else F.lit(True))
    return files.agg(F.count("*").alias("files_scanned"), F.count_if(fits).alias("qualifying"), F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0)).alias("total_size_bytes"))

"""How the driver's tables stand in for a media library: texts for pictures, documents for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..tables import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``(id, h)``: difference hash of each document's word grid, made once and kept for the query's joins."""
    grid = S.token_grid(table(spark, sf_dir, "documents"), "doc_id", "text", 72).filter("id IS NOT NULL")
    return Workspace(spark, "signatures").save(grid.select("id", S.difference_hash(F.col("grid")).alias("h")), "rows")


def three_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``(id, ahash, dhash, phash)``."""
    grids = S.token_grids(table(spark, sf_dir, "documents"), "doc_id", "text", 64, 72, 25).filter("id IS NOT NULL")
    hashes = [S.average_hash(F.col("grid_64")).alias("ahash"), S.difference_hash(F.col("grid_72")).alias("dhash"), S.gradient_hash(F.col("grid_25"), 5).alias("phash")]
    return Workspace(spark, "signatures").save(grids.select("id", *hashes), "rows")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``(id, path, size, text)``: a relative path that depends on the id's remainder by six."""
    i = F.col("doc_id").cast("string")
    month = F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")
    shapes = [F.concat(F.lit("IMG_"), i, F.lit(".jpg")), F.concat(F.lit("photos/DSC_"), i, F.lit(".PNG")), F.concat(F.lit("2024/"), month, F.lit("/trip_"), i, F.lit(".jpg")), F.concat(F.lit("vacation/beach/sunset_"), i, F.lit(".heic")), F.concat(F.lit("misc/Screenshot "), i, F.lit(".png")), F.concat(F.lit("docs/a/notes_"), i, F.lit(".txt"))]
    path = F.element_at(F.array(*shapes), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), F.col("n_chars").alias("size"), "text")

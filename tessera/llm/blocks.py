"""A stated query set against all vectors, in blocks of bounded size.

Rows are dealt to blocks by a hash; queries are cut into chunks; each block meets each chunk in one task.  Every query
leaves at most ``k`` rows per block, which are merged by rank afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def no_number(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def usable(vectors: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """Rows ``(vec_id, v, dim)`` of the vectors that take part: an id, no null, only finite components, not empty."""
    narrow = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = narrow.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", no_number))
    if not allow_zero:
        kept = kept.filter(F.exists("v", lambda x: x != 0))
    return kept.withColumn("dim", F.size("v"))


def search(rows: DataFrame, query: object, k: int, top: Callable, score_type: str, block_bytes: int = 32 << 20, chunk_queries: int = 16_384, least_blocks: int = 16) -> DataFrame:
    """``top(ids, vectors, query_ids, query_vectors)`` on each block and chunk, merged to ``k`` rows per query.

    ``rows`` has ``vec_id, v, dim``; ``query`` is the condition of the query rows.  ``top`` returns (query ids, ids, scores) with the
    best ``k`` of the block, in any order.  Vectors meet only vectors of their own length.  Blocks have about ``block_bytes`` bytes
    of vectors, and there are ``least_blocks`` at least.
    """
    n, n_queries, longest = rows.agg(F.count("*"), F.count(F.when(query, 1)), F.max("dim")).first()
    # Each query goes to every block, so blocks are as large as a task can hold.
    blocks = max(least_blocks, -(-n * 8 * (longest or 1) // block_bytes))
    to_block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    left = rows.select("dim", to_block.alias("block"), "vec_id", "v")
    right = rows.filter(query).select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    return search_blocks(left, right, k, top, score_type, max(1, -(-n_queries // chunk_queries)))


def search_blocks(rows: DataFrame, queries: DataFrame, k: int, top: Callable, score_type: str, chunks: int, entry: str | None = None, aside: str | None = None) -> DataFrame:
    """As :func:`search`, for ``rows`` and ``queries`` that name their ``block``: a query is there once for each block that it is to
    meet.  ``entry`` and ``aside`` name a number of each row and of each query; then ``top`` takes ``(ids, vectors, entries,
    query_ids, query_vectors, asides)``."""
    import numpy as np

    to_chunk = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(chunks)).cast("int")
    left = rows.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "v", *([entry] if entry else []))
    right = queries.select("dim", "block", to_chunk.alias("chunk"), "vec_id", "v", *([aside] if aside else []))

    def arrays(table: pa.Table, extra: str | None) -> tuple:
        v = table.column("v").combine_chunks()
        flat = v.flatten().to_numpy(zero_copy_only=False)
        found = table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)
        return (*found, table.column(extra).to_numpy()) if extra else found

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            q, i, s = top(*arrays(a, entry), *arrays(b, aside))
        else:
            q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": pa.array(q, a.schema.field("vec_id").type), "vec_id": pa.array(i, a.schema.field("vec_id").type), "score": pa.array(s, pa.int64() if score_type == "long" else pa.float64())})

    kind = rows.schema["vec_id"].dataType.simpleString()
    key = ["dim", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"query_id {kind}, vec_id {kind}, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Vector code compression: product codes whose nearest entries are exact.

Vectors become integers and are cut into equal parts; each part position has a codebook, trained by rounds of assignment and
mean.  The nearest entry is found by screening: a float32 matrix product gives every distance up to a rigorous bound on its
rounding error, so each entry has an interval that surely holds its true distance.  Where only one entry's interval reaches down
to the least upper end, it is the nearest; every other entry that reaches it is computed again in int64, and ties go to the lower
index.  Codes, sums and means are integers throughout, so results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace
from . import blocks

#: Unit roundoffs of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53
#: Rows that are screened at once.
SLICE = 1 << 14
#: Labels of more than one in so many rows are joined by a broadcast; there are fewer of them than this number.
HOT_SHARE = 1000
Books = dict[int, np.ndarray]


def intervals(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, radius) of |c|^2 - 2 x.c for integer points and entries: the true value lies within the radius.

    Rounding both factors to float32 and summing ``d`` products in any order, with or without fused steps, errs by at most
    gamma(d + 2) * sum |x||c| (gamma(n) = n u / (1 - n u)), and that sum is at most |x| |c|.  What is done in float64 adds a few
    of its own roundoffs of the largest term.
    """
    d = x.shape[1]
    dot = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    size_x = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + (d + 4) * U64)
    square = (book.astype(np.float64) ** 2).sum(axis=1)
    size_c = np.sqrt(square) * (1 + (d + 4) * U64)
    gamma = (d + 2) * U32 / (1 - (d + 2) * U32)
    product = size_x[:, None] * size_c[None]
    middle = square[None] - 2 * dot
    # float32 products below its smallest normal number lose less than 1 in all; integers have none but zero.
    radius = 2 * gamma * product * (1 + 8 * U64) + (d + 8) * U64 * (square[None] + 4 * product) * 2
    return middle, radius


def assign(x: np.ndarray, book: np.ndarray, checked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of integers, ties to the lower index, and its squared distance.  ``checked`` gets the number
    of distances that were computed in int64 beyond the one of each row's result."""
    index = np.empty(len(x), np.int64)
    for at in range(0, len(x), SLICE):
        own = x[at : at + SLICE]
        middle, radius = intervals(own, book)
        reached = (middle + radius).min(axis=1)
        open_ = middle - radius <= reached[:, None]
        best = open_.argmax(axis=1)
        several = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(several):
            row, entry = np.nonzero(open_[several])
            exact = ((own[several[row]] - book[entry]) ** 2).sum(axis=1)
            order = np.lexsort((entry, exact, row))
            first = np.searchsorted(row, np.arange(len(several)))  # rows are ascending, also in this order
            best[several] = entry[order[first]]
            if checked is not None:
                checked.append(len(row))
        index[at : at + SLICE] = best
    return index, ((x - book[index]) ** 2).sum(axis=1)


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integer vectors) of a batch with columns ``dim`` and ``v``."""
    dim = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    lists = batch.column(batch.schema.get_field_index("v"))
    for d in np.unique(dim):
        rows = np.flatnonzero(dim == d)
        yield int(d), rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _sums(rows: DataFrame, books: Books) -> dict[tuple[int, int, int], tuple[int, list[int]]]:
    """(count, sums) of the parts of each used entry, by (length, part, entry): added up in each task, then over the tasks."""
    if not books:
        return {}

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {d: np.zeros(b.shape[:2], np.int64) for d, b in books.items()}
        total = {d: np.zeros(b.shape, np.int64) for d, b in books.items()}
        for batch in batches:
            for d, _, v in _matrix(batch):
                book = books[d]
                for p, x in enumerate(np.split(v, len(book), axis=1)):
                    entry, _ = assign(x, book[p])
                    count[d][p] += np.bincount(entry, minlength=book.shape[1])
                    np.add.at(total[d][p], entry, x)
        for d, c in count.items():
            part, entry = np.nonzero(c)
            if len(part):
                sums = pa.array(list(total[d][part, entry]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d), pa.int32()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(c[part, entry]), sums], names=["dim", "part", "entry", "n", "total"])

    partial = rows.select("dim", "v").mapInArrow(added, "dim int, part int, entry int, n long, total array<long>")
    # One row for each entry and position; the codebooks' own size is all that reaches the driver.
    counts = partial.select("dim", "part", "entry", "n", F.posexplode("total").alias("at", "x"))
    found: dict[tuple[int, int, int], tuple[int, list[int]]] = {}
    for dim, part, entry, _, n, x in sorted(counts.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()):
        found.setdefault((dim, part, entry), (n, []))[1].append(x)
    return found


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> Books:
    """The codebooks (part, entry, position) of each length among ``rows`` (``vec_id, dim, v``, integers): they start with the
    vectors of the smallest ids (nulls last, equal ids by their vectors) and take ``rounds`` rounds."""
    books: Books = {}
    for (dim,) in sorted(rows.select("dim").distinct().collect()):
        first = rows.filter(F.col("dim") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        books[dim] = np.array([r.v for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for (dim, part, entry), (n, total) in _sums(rows, books).items():
            books[dim][part, entry] = [x // n for x in total]
    return books


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """``rows`` without their vectors, with ``code``, ``error`` and ``codebooks_sha256``."""
    digests = {d: digest(b) for d, b in books.items()}
    kept = [f for f in rows.schema.fields if f.name not in ("dim", "v")]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error, sha = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, "", object)
            for d, own, v in _matrix(batch):
                found = [assign(x, books[d][p]) for p, x in enumerate(np.split(v, len(books[d]), axis=1))]
                code[own] = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
                error[own], sha[own] = sum(e for _, e in found), digests[d]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array(error), pa.array(sha, pa.string())], names=[*(f.name for f in kept), "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(coded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code string, error long, codebooks_sha256 string")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of ``error`` over their label.  Labels that hold many rows are few, so their sums are broadcast and their
    rows stay where they are; only rows of rare labels are shuffled."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = sums.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_rows")))).withColumn("hot", F.col("n") * HOT_SHARE >= F.col("all_rows"))
    hot = sums.filter("hot").select(F.col("label").alias("own"), "label_error")
    rare = sums.filter("NOT hot").select(F.col("label").alias("own"), "label_error")
    here = F.col("label").eqNullSafe(F.col("own"))
    joined = rows.join(F.broadcast(hot), here, "left")
    found = joined.filter("label_error IS NOT NULL").drop("own")
    return found.unionByName(joined.filter("label_error IS NULL").drop("own", "label_error").join(rare, here).drop("own"))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows ``(vec_id, code, error, label_error, codebooks_sha256)``, one per vector that takes part.

    Components become ``floor(scale * x)``.  Rows whose vector is null or empty, holds a null or non-finite component, or has a
    length that ``parts`` does not divide, take no part.  Vectors of another length have codebooks of their own.  Null ids take
    part and come last in the first codebooks; repeated ids and rows each come back; null labels are one label; fewer vectors than
    ``entries`` give as many entries.  An empty table gives no rows.  Distances must fit in 64 bits: components beyond that raise
    an error that says so.  Other columns are not read.  At most 256 entries, as a code has two digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part: 1 to 256 entries")
    work = Workspace(vectors.sparkSession, "vector-codes")
    narrow = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = narrow.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & ~F.exists("v", blocks.no_number))
    most = F.sqrt(F.lit(2.0**61) * parts / F.size("v"))  # parts of d components: d * (2 most) ** 2 <= 2 ** 63
    whole = F.transform("v", lambda x: F.floor(x * float(scale)).cast("long"))
    fits = F.forall("v", lambda x: F.abs(x * float(scale)) < most - 1)
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large: squared distances must fit in 64 bits")).cast("array<bigint>"))
    rows = work.save(usable.select("vec_id", "label", F.size("v").alias("dim"), checked.alias("v")), "integers")
    coded = work.save(encode(rows, train(rows, parts, entries, rounds)), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle_sql(rounds: int = 6) -> str:
    """The query in DuckDB's SQL, for tables whose vectors have one length."""
    nearest = """
{name}_parts AS MATERIALIZED (
  SELECT id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT x.id, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d
    FROM flat x JOIN {book} c USING (part, pos) GROUP BY ALL
  ) GROUP BY ALL
)"""
    mean = """
{name} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT n.part, n.entry, f.pos, CAST((sum(f.x) - ((sum(f.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM {name}_parts n JOIN flat f USING (id, part) GROUP BY ALL
  ) m USING (part, entry, pos)
)"""
    steps = [
        """
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 8 = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """
flat AS MATERIALIZED (
  SELECT id, (i - 1) // (len(v) // 8) AS part, (i - 1) % (len(v) // 8) AS pos, v[i] AS x FROM kept, unnest(range(1, len(v) + 1)) AS r(i)
)""",
        """
c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, pos, x FROM flat WHERE id <= 16)""",
    ]
    for i in range(rounds):
        steps += [nearest.format(name=f"c{i + 1}", book=f"c{i}"), mean.format(name=f"c{i + 1}", book=f"c{i}")]
    steps.append(nearest.format(name="last", book=f"c{rounds}"))
    steps.append("""
coded AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last_parts GROUP BY id
)""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (id)
"""

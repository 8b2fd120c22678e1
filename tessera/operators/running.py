"""Running numbers, sums, maxima and previous values over ordered groups of any size.

A window over a whole group puts the group into one task.  Here only groups of up to ``group_rows`` rows are windows; the rows of
larger ones are range-partitioned by group and order, so that a group is spread over as many parts as it needs.  Each part runs by
itself, the parts' totals (a part has at most two groups that go on elsewhere) are accumulated, and every row adds what came
before its part.  The results are those of one window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Workspace

#: Groups of more rows are spread over several parts.
GROUP_ROWS = 100_000


@dataclass(frozen=True)
class Running:
    """The columns to add, by name: ``number`` counts from 1; ``sums`` include the row itself; ``maxima`` are those of the rows
    before it (null at the start); ``previous`` is the value of the row before (null at the start)."""

    number: str | None = None
    sums: dict[str, str] = field(default_factory=dict)
    maxima: dict[str, str] = field(default_factory=dict)
    previous: dict[str, str] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [*([self.number] if self.number else []), *self.sums, *self.maxima, *self.previous]


def _by_window(rows: DataFrame, keys: list, order: list[str], what: Running) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    up_to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    if what.number:
        out = out.withColumn(what.number, F.row_number().over(w).cast("long"))
    out = out.withColumns({name: F.sum(c).over(up_to) for name, c in what.sums.items()})
    out = out.withColumns({name: F.max(c).over(before) for name, c in what.maxima.items()})
    return out.withColumns({name: F.lag(c).over(w) for name, c in what.previous.items()})


def _by_parts(rows: DataFrame, keys: list[str], order: list[str], what: Running, parts: int) -> DataFrame:
    work = Workspace(rows.sparkSession, "running")
    # The table fixes which row is in which part.
    ranged = work.save(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "parts")
    local = _by_window(ranged, [*keys, "_part"], order, what)
    last = F.struct(*order)
    totals = ranged.groupBy(*keys, "_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in what.sums.items()], *[F.max(c).alias(f"_max_{n}") for n, c in what.maxima.items()],
        *[F.max_by(F.struct(c), last).alias(f"_last_{n}") for n, c in what.previous.items()],
    )
    # One row per part and group that it shares with another part: two per part at most.
    shared = totals.withColumn("_parts", F.count("*").over(Window.partitionBy(*keys))).filter("_parts > 1")
    w = Window.partitionBy(*keys).orderBy("_part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("_n").over(before).alias("_c_n")]
    carried += [F.sum(f"_sum_{n}").over(before).alias(f"_c_sum_{n}") for n in what.sums]
    carried += [F.max(f"_max_{n}").over(before).alias(f"_c_max_{n}") for n in what.maxima]
    carried += [F.lag(f"_last_{n}").over(w).alias(f"_c_last_{n}") for n in what.previous]
    carry = shared.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), *carried).filter("_c_n IS NOT NULL")
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carry), same, "left")
    full: dict[str, Column] = {n: F.coalesce(F.col(n) + F.col(f"_c_sum_{n}"), F.col(n), F.col(f"_c_sum_{n}")) for n in what.sums}
    full |= {n: F.greatest(n, f"_c_max_{n}") for n in what.maxima}
    # A part's first row has no row before it there; its group's last row of the parts before is the previous one.
    first = F.col("_first") == 1
    full |= {n: F.when(first, F.col(f"_c_last_{n}").getField(c)).otherwise(F.col(n)) for n, c in what.previous.items()}
    if what.number:
        full[what.number] = F.col(what.number) + F.coalesce("_c_n", F.lit(0))
    if what.previous:
        joined = joined.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return joined.select(*rows.columns, *[full[n].alias(n) for n in what.names()])


def running(rows: DataFrame, keys: list[str], order: list[str], what: Running, group_rows: int = GROUP_ROWS, parts: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``what`` over each group of ``keys`` in ascending ``order`` (nulls first).

    Null keys are one group.  ``order`` should tell all rows of a group apart; rows that it does not may come in either order.
    Groups of over ``group_rows`` rows are worked on in ``parts`` parts (one for each ``group_rows`` rows of them, and at least
    as many as the session has shuffle partitions).  Result columns must not exist in ``rows``.
    """
    if clash := set(what.names()) & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > group_rows)
    n, total = sizes.agg(F.count("*"), F.sum("_rows")).first()
    if not n:
        return _by_window(rows, keys, order, what)
    large = Workspace(rows.sparkSession, "running").save(sizes, "large")
    there = F.lit(True)
    named = large.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    for k in keys:
        there = there & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # Each of them has over group_rows rows, so they are few.
    small = rows.join(F.broadcast(named), there, "left_anti")
    hot = rows.join(F.broadcast(named), there, "left_semi")
    parts = parts or max(-(-total // group_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _by_window(small, keys, order, what).unionByName(_by_parts(hot, keys, order, what, parts))

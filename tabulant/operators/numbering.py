"""Running sums and row numbers over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of consecutive positions that one window holds.
CHUNK = 65_536


def running_before(rows: DataFrame, order: list[str], value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before, by ``order``.

    The last column of ``order`` is a whole number, unique within the others.
    Rows are cut into runs of ``chunk`` such numbers; runs are summed first, and
    only their sums (one light row per run) are put in order together.
    """
    run = [*[F.col(c).alias(f"_run{i}") for i, c in enumerate(order[:-1])], F.floor(F.col(order[-1]) / chunk).alias("_run")]
    names = [*[f"_run{i}" for i in range(len(order) - 1)], "_run"]
    cut = rows.select("*", *run, value.cast("long").alias("_value"))
    sums = cut.groupBy(*names).agg(F.sum("_value").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(c).alias(f"{c}_") for c in names], earlier.alias("_start"))
    within = F.coalesce(F.sum("_value").over(Window.partitionBy(*names).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("_within", within).join(starts, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names])
    return placed.select(*rows.columns, (F.col("_start") + F.col("_within")).alias(name))


def numbered(rows: DataFrame, order: list[str], name: str = "row_no", chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: 0, 1, 2 and so on by ``order`` (see ``running_before``)."""
    return running_before(rows, order, F.lit(1), name, chunk)

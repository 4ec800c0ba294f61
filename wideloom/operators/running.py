"""Running totals over a globally ordered column, spread over many tasks.

A window without partition keys sorts the whole table in one task.  Here the ordered column
is cut into value ranges by a range partitioning of a stored table; totals per range give each
range its starting offset, and the window runs inside a range only.  The number of ranges follows
the rows without a limit, and no cut point becomes part of a plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wideloom.session import cut

RANGE_ROWS = 500_000


def running_totals_by(df: DataFrame, by: str, order: str, sums: Sequence[str], *, descending: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``cum_<name>`` (inclusive) for each of ``sums`` inside every ``by``, all groups in one pass.

    ``df`` must hold one row per (``by``, ``order``); group first, so that a value shared by a large part of a table is
    a single row here, and store it with ``cut``, as it is read more than once.  Large tables are dealt by ranges of
    (``by``, ``order``): a group may span any number of tasks and a task may hold many groups.
    """
    along = F.col(order).desc() if descending else F.col(order).asc()
    ranges = math.ceil(df.count() / range_rows)
    if ranges <= 1:
        inside = W.partitionBy(by).orderBy(along).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(s).over(inside).alias(f"cum_{s}") for s in sums])
    ranged = _ranged(df, ranges, F.col(by), along)
    before = W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(by, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums]).select(
        by, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = W.partitionBy(by, "_range").orderBy(along).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(offsets, [by, "_range"]).select(
        *df.columns, *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums])


def _ranged(df: DataFrame, ranges: int, *order: Column) -> DataFrame:
    """``df`` stored with the number of its range, ascending along ``order``; the numbers are fixed by storing them."""
    return cut(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))


def sorted_index(df: DataFrame, key: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the 0-based position of every row by ``key``, whose values must be distinct.

    Small tables use one window.  Larger ones are dealt by ranges of the key.
    """
    ranges = math.ceil(df.count() / range_rows)
    if ranges <= 1:
        return df.withColumn(out, F.row_number().over(W.orderBy(key)).cast("bigint") - 1)
    ranged = _ranged(df, ranges, F.col(key))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1 + F.col("_o")
    return ranged.join(F.broadcast(offsets), "_range").select(*df.columns, place.alias(out))

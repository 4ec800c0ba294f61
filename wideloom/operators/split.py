"""Reproducible train/test split and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wideloom.functions.columns import col
from wideloom.operators.counts import BROADCAST_BYTES, lookup
from wideloom.session import cut

TEST_SHARE = 0.2
SEED = 42
CELL_ROWS = 1_000_000


def shuffle_key(keys: Sequence[str], seed: int = SEED) -> Column:
    """Pseudo-random order that depends on the row's keys only, so a retried task agrees."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))


def with_split(df: DataFrame, keys: Sequence[str], target: str | None = None, *, test_share: float = TEST_SHARE,
               seed: int = SEED, out: str = "is_test", cell_rows: int = CELL_ROWS,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark an exact, per-class share of the rows as test rows.

    Rows are ordered by a hash of their keys and the first ones of each class form the test
    part; rows with equal keys stay together.  The hash prefix cuts every class into even
    cells.  Only the cell in which a class fills its quota is looked at hash by hash, to find
    the class's last test hash.  Both tables of one row per class are stored and measured before
    they are looked up: while they fit in a broadcast the table itself is neither shuffled nor sorted,
    and beyond that classes with many rows are still broadcast.
    """
    n = df.count()
    digits = 1
    while 16 ** digits * cell_rows < n and digits < 8:
        digits += 1
    group = F.lit("") if target is None else F.coalesce(col(target).cast("string"), F.lit("missing"))
    keyed = df.withColumns({"_o": shuffle_key(keys, seed), "_y": group})
    placed = keyed.select("_y", "_o", F.substring("_o", 1, digits).alias("_cell"))
    by_class = W.partitionBy("_y")
    upto = by_class.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    rows = F.sum("_n").over(by_class)
    quota = F.floor(rows * F.lit(test_share) + 0.5)
    left = quota - (F.sum("_n").over(upto) - F.col("_n"))
    # At most 16^digits rows per class, then one row per class.
    ends = cut(
        placed.groupBy("_y", "_cell").agg(F.count("*").alias("_n"))
        .select("_y", "_cell", left.alias("_left"), rows.alias("_rows")).where("_left > 0")
        .groupBy("_y").agg(F.max(F.struct("_cell", "_left", "_rows")).alias("_end")).select("_y", "_end", "_end._rows")
    )
    before = F.sum("_n").over(by_class.orderBy("_o").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    last = cut(
        lookup(placed, "_y", ends, "_rows", F.lit(None), "_end", broadcast_bytes=broadcast_bytes).where("_cell = _end._cell")
        .groupBy("_y", "_o", "_end").agg(F.count("*").alias("_n"))
        .select("_y", "_o", "_end", before.alias("_before")).where("_before < _end._left")
        .groupBy("_y").agg(F.max("_o").alias("_last"), F.max("_end._rows").alias("_rows"))
    )
    return lookup(keyed, "_y", last, "_rows", F.lit(None).cast("string"), "_last", broadcast_bytes=broadcast_bytes).select(
        *[col(c) for c in df.columns], F.coalesce(F.col("_o") <= F.col("_last"), F.lit(False)).alias(out))


def train_test(df: DataFrame, keys: Sequence[str], target: str | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, keys, target, **kw)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def split_sizes(marked: DataFrame, target: str | None = None) -> DataFrame:
    by = [] if target is None else [target]
    return marked.groupBy(*by).agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``(class, cnt, weight)`` with weight n / (classes x count)."""
    counts = df.groupBy(F.coalesce(col(target).cast("string"), F.lit("missing")).alias("class")).agg(F.count("*").alias("cnt"))
    totals = counts.agg(F.struct(F.sum("cnt").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.select("class", "cnt", (totals["n"] / (totals["k"] * F.col("cnt"))).alias("weight"))

"""Mutual information of numeric columns and a class by nearest neighbours, without bins.

For every row the distance to its k-th neighbour of the same class is taken, then the rows of all classes within that
distance are counted; digammas of these counts give the information (Ross).  Columns are one dimension each, so
neighbours are neighbours in sorted order: equal values of a class are one row with a count, sorted values are cut into
ranges, each range gets the k values on either side of it, and counts below a value are offsets of ranges plus places
inside them.  No range holds a whole column and no pair of rows is formed.

Where k or more rows of the class share a value, the distance is none and k becomes their number, so columns with few
values get the information of their counts.  Classes of one row are left out; smaller classes use all their rows.  Nulls
count as 0 in columns and as a class of their own in the target, NaN likewise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wideloom.functions.columns import col, families, label_of, melt, number
from wideloom.session import cut, ship

NEIGHBOURS = 3
RANGE_ROWS = 500_000
MOST_RANGES = 20_000   # cut points that the driver holds per column


def digamma(n: Column) -> Column:
    """Of a positive number: six steps up, then the asymptotic series."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return series - sum((1 / (n.cast("double") + i) for i in range(6)), F.lit(0.0))


def neighbour_information(df: DataFrame, target: str, names: Sequence[str] | None = None, *, k: int = NEIGHBOURS,
                          range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(column, mi)`` in nats for a target of classes."""
    names = [n for n in (families(df).numeric if names is None else names) if n != target]
    ship(df.sparkSession)
    y = F.coalesce(col(target).cast("string"), F.lit("missing"))
    long = melt(df, [[F.coalesce(number(df, n), F.lit(0.0)), y] for n in names], ["x", "y"])
    values = cut(long.groupBy("ci", "y", (F.col("x") + 0.0).alias("x")).agg(F.count("*").alias("n")))
    size = values.groupBy("ci", "y").agg(F.sum("n").alias("size"))
    values = cut(values.join(size, ["ci", "y"]).where("size > 1"))
    cuts = _cut_points(values, len(names), range_rows)
    ranged = cut(values.withColumn("part", _part(cuts, "x")))
    radius = cut(_radii(ranged, k))
    counted = _within(radius, ranged, cuts)
    n = F.col("n").cast("double")
    mean = lambda c: F.sum(n * digamma(c)) / F.sum("n")
    mi = digamma(F.sum("n")) + mean(F.col("k")) - mean(F.col("size")) - mean(F.col("m"))
    return counted.groupBy("ci").agg(F.greatest(mi, F.lit(0.0)).alias("mi")).select(label_of(names, F.col("ci")).alias("column"), "mi")


def _cut_points(values: DataFrame, columns: int, range_rows: int) -> list[np.ndarray]:
    """Values that cut each column into ranges of about ``range_rows`` values; they only balance the work."""
    most = values.groupBy("ci").agg(F.count("*").alias("c")).agg(F.max("c")).head()[0] or 0
    ranges = min(MOST_RANGES, -(-most // range_rows))
    if ranges <= 1:
        return [np.zeros(0)] * columns
    shares = [i / ranges for i in range(1, ranges)]
    found = {r["ci"]: r["p"] for r in values.groupBy("ci").agg(F.percentile_approx("x", shares, max(10_000, 4 * ranges)).alias("p")).collect()}
    return [np.unique(np.array(found.get(i) or [], np.float64)) for i in range(columns)]


def _part(cuts: list[np.ndarray], value: str) -> Column:
    """Number of the range of a value, by binary search."""
    @F.pandas_udf("int")
    def place(ci, x):
        import pandas as pd
        out = np.zeros(len(ci), np.int32)
        for i in np.unique(ci.to_numpy()):
            here = ci.to_numpy() == i
            out[here] = np.searchsorted(cuts[i], x.to_numpy()[here], "right")
        return pd.Series(out)
    return place("ci", value) if any(len(c) for c in cuts) else F.lit(0)


def _radii(ranged: DataFrame, k: int) -> DataFrame:
    """Every value of a class with the distance to its k-th neighbour there, and the k in use."""
    keys = ["ci", "y", "part"]
    low = F.row_number().over(W.partitionBy(*keys).orderBy("x"))
    high = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("x")))
    # k + 1 values at either end of each range: the sides of its neighbours.
    ends = cut(ranged.withColumn("l", low).withColumn("h", high).where((F.col("l") <= k + 1) | (F.col("h") <= k + 1)).select("ci", "y", "part", "x", "n"))

    def lend(group: pa.Table) -> pa.Table:
        group = group.sort_by("x")
        part, x, n = (group.column(c).to_numpy() for c in ("part", "x", "n"))
        out = []
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, p, "left"), np.searchsorted(part, p, "right")
            out += [(p, x[i], n[i]) for i in [*range(max(0, lo - k - 1), lo), *range(hi, min(len(x), hi + k + 1))]]
        count = len(out)
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([group.column("ci")[:1].take(pa.array([0] * count, pa.int64())), group.column("y")[:1].take(pa.array([0] * count, pa.int64())),
                         pa.array(np.asarray(columns[0], np.int32)), pa.array(np.asarray(columns[1], np.float64)), pa.array(np.asarray(columns[2], np.int64))],
                        names=["ci", "y", "part", "x", "n"])
    schema = f"ci {ranged.schema['ci'].dataType.simpleString()}, y string, part int, x double, n bigint"
    lent = ends.groupBy("ci", "y").applyInArrow(lend, schema).withColumn("own", F.lit(False)).withColumn("size", F.lit(0).cast("bigint"))
    both = ranged.select("ci", "y", "part", "x", "n", F.lit(True).alias("own"), F.col("size").cast("bigint").alias("size")).unionByName(lent)

    def measure(group: pa.Table) -> pa.Table:
        group = group.sort_by("x")
        x, n, own, size = (group.column(c).to_numpy(zero_copy_only=False) for c in ("x", "n", "own", "size"))
        want = np.minimum(k, size - 1)
        far, used = np.zeros(len(x)), np.maximum(n - 1, 1)
        need = np.where(n - 1 >= want, 0, want - (n - 1))
        left, right = np.arange(len(x)), np.arange(len(x))
        open_ = np.flatnonzero(own & (need > 0))
        used[open_] = want[open_]
        while len(open_):   # at most k steps: each takes the nearer side
            l, r = left[open_] - 1, right[open_] + 1
            dl = np.where(l >= 0, x[open_] - x[np.maximum(l, 0)], np.inf)
            dr = np.where(r < len(x), x[np.minimum(r, len(x) - 1)] - x[open_], np.inf)
            go_left = dl <= dr
            left[open_[go_left]] -= 1
            right[open_[~go_left]] += 1
            taken = np.where(go_left, n[np.maximum(l, 0)], n[np.minimum(r, len(x) - 1)])
            far[open_] = np.minimum(dl, dr)
            need[open_] -= taken
            open_ = open_[need[open_] > 0]
        keep = pa.array(own.astype(bool))
        return group.drop_columns(["own"]).append_column("far", pa.array(far)).append_column("k", pa.array(used.astype(np.int64))).filter(keep)
    schema = f"{schema}, size bigint, far double, k bigint"
    return both.groupBy(*keys).applyInArrow(measure, schema)


def _within(radius: DataFrame, ranged: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Add ``m``: rows of all classes nearer than ``far``, or at the same value where that is none."""
    every = cut(ranged.groupBy("ci", "part", "x").agg(F.sum("n").alias("n")))
    offsets = [np.zeros(len(c) + 2, np.int64) for c in cuts]
    for r in every.groupBy("ci", "part").agg(F.sum("n").alias("n")).collect():   # a row per range
        offsets[r["ci"]][r["part"] + 1] = r["n"]
    offsets = [np.cumsum(o) for o in offsets]
    none = F.col("far") == 0
    # Rows below the upper end less rows up to the lower one; ends of no distance take the value in.
    probes = F.array(F.struct((F.col("x") + F.col("far")).alias("at"), none.alias("closed"), F.lit(1).alias("factor")),
                     F.struct((F.col("x") - F.col("far")).alias("at"), (~none).alias("closed"), F.lit(-1).alias("factor")))
    asked = radius.select("ci", "y", "x", F.explode(probes).alias("p")).select("ci", "y", "x", "p.*").withColumn("part", _part(cuts, "at"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("x")
        x, run = right.column("x").to_numpy(), np.concatenate([[0], np.cumsum(right.column("n").to_numpy())])
        at, closed = left.column("at").to_numpy(), left.column("closed").to_numpy(zero_copy_only=False).astype(bool)
        place = np.where(closed, np.searchsorted(x, at, "right"), np.searchsorted(x, at, "left"))
        before = offsets[left.column("ci")[0].as_py()][left.column("part")[0].as_py()] if left.num_rows else 0
        below = (before + run[place].astype(np.int64)) * left.column("factor").to_numpy()
        return pa.table([left.column("ci"), left.column("y"), left.column("x"), pa.array(below)], names=["ci", "y", "x", "below"])
    kind = ranged.schema["ci"].dataType.simpleString()
    keyed = every.select(F.col("ci").alias("c"), F.col("part").alias("r"), "x", "n")
    found = asked.groupBy("ci", "part").cogroup(keyed.groupBy("c", "r")).applyInArrow(count, f"ci {kind}, y string, x double, below bigint")
    m = found.groupBy("ci", "y", "x").agg(F.sum("below").alias("m"))
    return radius.join(m, ["ci", "y", "x"])

"""Scaling, leakage and sufficiency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wideloom.functions.columns import families, melt, number
from wideloom.operators.relations import pairwise_r


def zscore(df: DataFrame, names: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Columns centred and divided by their sample deviation; constants become 0."""
    rows = {r["ci"]: r for r in melt(df, [[number(df, n)] for n in names], ["x"]).groupBy("ci")
            .agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()}
    out = []
    for i, n in enumerate(names):
        r = rows.get(i)
        if r is None or not r["s"]:
            scaled = F.when(number(df, n).isNotNull(), F.lit(0.0))
        else:
            scaled = (number(df, n) - F.lit(r["m"])) / F.lit(r["s"])
        out.append(scaled.alias(n + suffix))
    return df.select("*", *out)


def leakage_risk(df: DataFrame, target: str, names: Sequence[str] | None = None, above: float = 0.99) -> DataFrame:
    """``(column, strength)`` of features that give the target away.

    Strength is |r| with the target, and for a 0/1 target also the single-feature AUC, all from one
    value-count pass and distributed ranks.
    """
    from wideloom.operators.evaluate import roc_auc_many

    names = [n for n in (families(df).numeric if names is None else names) if n != target]
    found = pairwise_r(df, [(n, target) for n in names]).select(F.col("a").alias("column"), F.abs("r").alias("strength"))
    ends = df.agg(F.min(number(df, target)), F.max(number(df, target)), F.count_if(~number(df, target).isin(0.0, 1.0))).head()
    if ends[0] == 0 and ends[1] == 1 and ends[2] == 0:
        areas = roc_auc_many(df, target, names)
        found = found.unionByName(areas.select("column", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("strength")))
    return found.where(F.col("strength") > above).groupBy("column").agg(F.max("strength").alias("strength"))


def data_sufficiency(df: DataFrame, target: str, *, min_rows: int = 500, min_signal: float = 0.05) -> DataFrame:
    """Row count and strongest correlation with the target against their minimum."""
    names = [n for n in families(df).numeric if n != target]
    best = pairwise_r(df, [(n, target) for n in names]).agg(F.max(F.abs("r")).alias("v")).scalar()
    base = df.agg(F.count("*").alias("n")).select("n", F.coalesce(best, F.lit(0.0)).alias("signal"))
    return base.select(F.inline(F.array(
        F.struct(F.lit("rows").alias("check"), F.col("n").cast("double").alias("value"), (F.col("n") >= min_rows).alias("passed")),
        F.struct(F.lit("signal").alias("check"), F.col("signal").alias("value"), (F.col("signal") >= min_signal).alias("passed")))))

"""Statistical feature selection: variance, correlation, univariate F and add-back."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wideloom.functions.columns import col, families, label_of, melt, number
from wideloom.functions.rules import Rule, fired
from wideloom.operators.relations import is_classification, pairwise_r

MIN_VARIANCE = 0.01
MAX_CORRELATION = 0.95
KEEP_PERCENTILE = 70
KEEP_RATIO = 0.8
METHODS = ("variance", "correlation", "univariate")


@dataclass(frozen=True)
class Selection:
    data: DataFrame
    kept: list[str]
    removed: list[str]
    scores: dict[str, float]
    reasons: dict[str, str]
    methods: list[str]
    target: str | None

    def frame(self) -> DataFrame:
        """``(feature, kept, score, reason)``."""
        rows = [(f, f in self.kept, self.scores.get(f), self.reasons.get(f, "")) for f in [*self.kept, *self.removed]]
        return self.data.sparkSession.createDataFrame(rows, "feature string, kept boolean, score double, reason string")


def variances(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(feature, variance)``: population variance, nulls ignored."""
    names = list(families(df).numeric if names is None else names)
    return (
        melt(df, [[number(df, n)] for n in names], ["x"]).groupBy("ci")
        .agg(F.var_pop("x").alias("variance"))
        .select(label_of(names, F.col("ci")).alias("feature"), "variance")
    )


def anova_f(df: DataFrame, target: str, names: Sequence[str] | None = None) -> DataFrame:
    """``(feature, score)``: one-way F of each numeric feature over the classes of the target.

    Nulls of a feature count as 0 and null classes form their own class.  Sums per class are
    taken around the feature's mean.
    """
    names = [n for n in (families(df).numeric if names is None else names) if n != target]
    filled = {n: F.coalesce(number(df, n), F.lit(0.0)) for n in names}
    means = {r["ci"]: r["m"] for r in melt(df, [[v] for v in filled.values()], ["x"])
             .groupBy("ci").agg(F.avg("x").alias("m")).collect()}
    y = F.coalesce(col(target).cast("string"), F.lit("missing"))
    d = F.col("x")
    per_class = (
        melt(df, [[v - F.lit(means.get(i) or 0.0), y] for i, v in enumerate(filled.values())], ["x", "y"])
        .groupBy("ci", "y").agg(F.count("*").cast("double").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    )
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    within = q - F.sum(F.col("s") * F.col("s") / F.col("n"))
    k = F.count("*")
    return (
        per_class.groupBy("ci")
        .agg(F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k)).alias("score"))
        .select(label_of(names, F.col("ci")).alias("feature"), "score")
    )


def f_regression(df: DataFrame, target: str, names: Sequence[str] | None = None) -> DataFrame:
    """``(feature, score)``: F of a one-variable regression; feature nulls 0, target nulls mean."""
    names = [n for n in (families(df).numeric if names is None else names) if n != target]
    mean, n = df.agg(F.avg(number(df, target)), F.count("*")).head()
    filled = df.select(*[F.coalesce(number(df, c), F.lit(0.0)).alias(c) for c in names],
                       F.coalesce(number(df, target), F.lit(mean or 0.0)).alias(target))
    r2 = F.col("r") * F.col("r")
    return pairwise_r(filled, [(c, target) for c in names]).select(
        F.col("a").alias("feature"), (F.try_divide(r2, 1 - r2) * (n - 2)).alias("score"))


def keep_percentile(scores: Sequence[float | None], percentile: float = KEEP_PERCENTILE) -> list[bool]:
    """Mask of the best ``percentile`` percent; ties at the threshold fill up in column order."""
    values = np.array([-math.inf if s is None or math.isnan(s) else s for s in scores], dtype="float64")
    finite = np.where(np.isneginf(values), np.finfo("float64").min, values)
    threshold = np.percentile(finite, 100 - percentile)
    mask = finite > threshold
    room = int(len(finite) * percentile / 100) - int(mask.sum())
    for i in np.flatnonzero(finite == threshold)[:max(room, 0)]:
        mask[i] = True
    return mask.tolist()


def correlation_drops(pairs: Iterable[tuple[str, str, float | None]], order: Sequence[str],
                      target_r: dict[str, float] | None, above: float = MAX_CORRELATION) -> list[str]:
    """Features to drop among highly correlated ones.

    With a target, the later column of a pair goes when it is less correlated with the target
    than the earlier one; without a target the first half of the flagged columns goes.
    """
    partners: dict[str, list[str]] = {}
    for a, b, r in pairs:
        if r is not None and abs(r) > above:
            partners.setdefault(b, []).append(a)
    flagged = [c for c in order if c in partners]
    if target_r is None:
        return flagged[: len(flagged) // 2]
    return [c for c in flagged if any(target_r.get(c, 0.0) < target_r.get(p, 0.0) for p in partners[c])]


def select_features(
    df: DataFrame,
    target: str | None = None,
    *,
    task: str | None = None,
    methods: Sequence[str] = METHODS,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> Selection:
    features = [c for c in df.columns if c != target]
    numeric = [c for c in families(df).numeric if c != target]
    kept, removed = list(features), []
    scores: dict[str, float] = {}
    reasons: dict[str, str] = {}
    used: list[str] = []

    def drop(names: Sequence[str], reason: str) -> None:
        for n in names:
            kept.remove(n)
            removed.append(n)
            reasons[n] = reason

    if "variance" in methods and numeric:
        low = {r["feature"] for r in variances(df, numeric).collect()
               if r["variance"] is None or r["variance"] <= MIN_VARIANCE}
        if low:
            scores.update({n: 0.0 for n in low})
            drop([n for n in numeric if n in low], "low variance")
            used.append("variance")
    if "correlation" in methods:
        live = [n for n in numeric if n in kept]
        if len(live) > 1:
            pairs = list(itertools.combinations(live, 2))
            by_target = target in families(df).numeric if target else False
            rows = pairwise_r(df, pairs + ([(n, target) for n in live] if by_target else [])).collect()
            target_r = None if target is None else {
                r["a"]: abs(r["r"]) for r in rows if r["b"] == target and r["r"] is not None}
            gone = correlation_drops([(r["a"], r["b"], r["r"]) for r in rows if r["b"] != target], live, target_r)
            if gone:
                drop(gone, "correlated")
                used.append("correlation")
    if "univariate" in methods and target is not None and len(kept) > 1:
        live = [n for n in numeric if n in kept]
        if live:
            table = anova_f(df, target, live) if is_classification(df, target, task) else f_regression(df, target, live)
            found = {r["feature"]: r["score"] for r in table.collect()}
            mask = keep_percentile([found.get(n) for n in live])
            scores.update({n: found[n] for n in live if found.get(n) is not None})
            gone = [n for n, ok in zip(live, mask) if not ok]
            if gone:
                drop(gone, "weak univariate score")
            used.append("univariate")
    for name in feature_addback(features, kept, removed, scores):
        removed.remove(name)
        kept.append(name)
        reasons[name] = "added back"
    for name in include:
        if name in removed:
            removed.remove(name)
            kept.append(name)
            reasons[name] = "forced in"
    for name in exclude:
        if name in kept:
            drop([name], "forced out")
    columns = [*kept, *([target] if target else [])]
    return Selection(df.select(*[col(c) for c in columns]), kept, removed, scores, reasons, used, target)


def feature_addback(features, kept, removed, scores, ratio: float = KEEP_RATIO) -> list[str]:
    """Removed features with a positive score to re-add, best first, up to the kept ratio."""
    wanted = max(1, int(len(features) * ratio)) - len(kept)
    ranked = sorted((f for f in removed if scores.get(f, 0.0) > 0), key=lambda f: -scores[f])
    return ranked[: max(wanted, 0)]


def selection_summary(result: Selection) -> DataFrame:
    before, after = len(result.kept) + len(result.removed), len(result.kept)
    row = (before, after, before - after, 100.0 * (before - after) / before if before else 0.0,
           result.methods, len(result.methods))
    return result.data.sparkSession.createDataFrame(
        [row], "features_before bigint, features_after bigint, removed bigint, reduction_pct double, "
               "methods array<string>, n_methods bigint")


def selection_advice(summary: DataFrame) -> DataFrame:
    c = F.col
    return fired(summary, [
        Rule("warning", "very_large_reduction", c("reduction_pct") > 70, c("reduction_pct")),
        Rule("suggestion", "large_reduction", c("reduction_pct") > 60, c("reduction_pct")),
        Rule("suggestion", "single_method", c("n_methods") == 1, c("n_methods")),
        Rule("suggestion", "few_features", c("features_after") < 5, c("features_after")),
        Rule("suggestion", "correlated_removed", F.array_contains("methods", "correlation"), F.lit(1.0)),
        Rule("review", "needs_review", c("reduction_pct") > 50, F.lit(1.0)),
    ])

"""Exact metrics and curves over a scored table (label, prediction, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


from wideloom.functions.columns import label_of, melt, number
from wideloom.functions.rules import Rule, fired
from wideloom.operators.quantiles import exact_quantiles
from wideloom.operators.running import running_totals_by
from wideloom.session import cut



def _share(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 with class 1 as positive."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y == p).alias("hit"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y != 1) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p != 1)).alias("fn"))
    return (
        counts.select(*by, "n", _share(F.col("hit"), F.col("n")).alias("accuracy"),
                      _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
        .select(*by, "n", "accuracy", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("cnt"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro and weighted rows.

    Everything derives from the confusion counts, so the table is read once.
    """
    cells = confusion_matrix(df, label, prediction)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").cast("string").alias("class"), F.col("cnt").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("cnt").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    )))
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]).select(
        "class", "support", "tp", _share(F.col("tp"), F.col("predicted")).alias("precision"),
        _share(F.col("tp"), F.col("support")).alias("recall"),
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    w = F.col("support")
    totals = per.agg(
        F.sum("tp").alias("hits"), F.sum(w).alias("n"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(m) * w), F.sum(w)).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )
    accuracy = _share(F.col("hits"), F.col("n"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("n").alias("support"))
        for name, p, r, f in (
            ("accuracy", accuracy, accuracy, accuracy),
            ("macro avg", *[F.col(f"macro_{m}") for m in ("precision", "recall", "f1")]),
            ("weighted avg", *[F.col(f"weighted_{m}") for m in ("precision", "recall", "f1")]),
        )
    ])
    return per.select("class", "precision", "recall", "f1", "support").unionByName(totals.select(F.inline(rows)))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 for any number of classes."""
    report = class_report(df, label, prediction)
    pick = lambda name, c: F.max(F.when(F.col("class") == name, F.col(c)))
    return report.agg(
        pick("accuracy", "precision").alias("accuracy"), pick("weighted avg", "precision").alias("precision"),
        pick("weighted avg", "recall").alias("recall"), pick("weighted avg", "f1").alias("f1"))


def _sweep(df: DataFrame, label: str, score: str, descending: bool) -> tuple[DataFrame, Column, Column]:
    """One row per distinct score with its positives, negatives and running totals; and both class totals.

    The input is read once; all the rest reads the stored counts by score.
    """
    scored = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        F.col(score).cast("double").alias("score"), (F.col(label) == 1).cast("bigint").alias("y"))
    grouped = cut(scored.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("_all", F.lit(0)))
    p, n = (grouped.agg(F.coalesce(F.sum(c), F.lit(0))).scalar() for c in ("pos", "neg"))
    return running_totals_by(grouped, "_all", "score", ["pos", "neg"], descending=descending), p, n


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with average ranks for tied scores."""
    s, _, _ = _sweep(df, label, score, descending=False)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0
    return s.agg(F.try_divide(F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def roc_auc_many(df: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """``(column, roc_auc)`` of every column as a score of a 0/1 label; the table is read once, whatever their number.

    A column has no area if its scored rows are of one class or none.
    """
    long = melt(df, [[number(df, n), number(df, label)] for n in names], ["score", "y"]).where("score IS NOT NULL AND y IS NOT NULL")
    grouped = long.groupBy("ci", "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    s = running_totals_by(cut(grouped), "ci", "score", ["neg"])
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0
    area = F.try_divide(F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg"))
    return s.groupBy("ci").agg(area.alias("roc_auc")).select(label_of(names, F.col("ci")).alias("column"), "roc_auc")


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score, highest first; starts after (0, 0)."""
    s, p, n = _sweep(df, label, score, descending=True)
    return s.select(
        F.col("score").alias("threshold"), _share(F.col("cum_neg"), n).alias("fpr"), _share(F.col("cum_pos"), p).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``(threshold, precision, recall)`` for every distinct score."""
    s, p, _ = _sweep(df, label, score, descending=True)
    return s.select(
        F.col("score").alias("threshold"), _share(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        _share(F.col("cum_pos"), p).alias("recall"))


def curve_areas(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoid areas of both curves.  Each point knows its predecessor from its own counts."""
    s, _, _ = _sweep(df, label, score, descending=True)
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    tp0, fp0 = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    roc = F.sum(F.col("neg").cast("double") * (tp0 + F.col("cum_pos")) / 2.0)
    precision = _share(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(_share(tp0, tp0 + fp0))
    pr = F.sum(F.col("pos").cast("double") * (precision + before) / 2.0)
    return s.agg(F.try_divide(roc, p * n).alias("roc_area"), F.try_divide(pr, p).alias("pr_area"))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The thresholds with the best F1 and the best Youden index; the higher one on ties."""
    s, p, n = _sweep(df, label, score, descending=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    points = s.select("score", _share(2 * tp, tp + fp + p).alias("f1"), (_share(tp, p) - _share(fp, n)).alias("youden"))
    best = lambda m: F.max(F.struct(F.round(m, 12).alias("v"), F.col("score").alias("t")))
    return points.agg(best("f1").alias("a"), best("youden").alias("b")).select(
        F.col("a.t").alias("f1_threshold"), F.col("a.v").alias("best_f1"),
        F.col("b.t").alias("youden_threshold"), F.col("b.v").alias("best_youden"))


def distributions(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(side, value, cnt)`` for labels and predictions, from the confusion counts."""
    cells = confusion_matrix(df, label, prediction)
    both = cells.select(F.inline(F.array(
        F.struct(F.lit("label").alias("side"), F.col("label").cast("string").alias("value"), "cnt"),
        F.struct(F.lit("prediction").alias("side"), F.col("prediction").cast("string").alias("value"), "cnt"))))
    return both.groupBy("side", "value").agg(F.sum("cnt").alias("cnt"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """R2, MSE, RMSE and MAE from one aggregation."""
    y = F.col(label).cast("double")
    e = y - F.col(prediction).cast("double")
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("var"))
    r2 = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return sums.select(*by, "n", r2.alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae")


def residual_stats(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    pairs = residual_pairs(df, label, prediction)
    q1, q3 = exact_quantiles(pairs, ["residual"], [0.25, 0.75])["residual"]
    r = F.col("residual")
    return pairs.agg(
        F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"),
    ).select("mean", "std", "min", "max", F.lit(q1).cast("double").alias("q25"), F.lit(q3).cast("double").alias("q75"))


def residual_pairs(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.select(F.col(prediction).cast("double").alias("prediction"),
                     (F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))


def prediction_stability(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Mean, population deviation and their ratio; no row for ten predictions or fewer."""
    p = F.col(prediction).cast("double")
    return df.agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std")).where("n > 10").select(
        "mean", "std", (F.col("std") / (F.col("mean") + 1e-8)).alias("cv"))


def importance_share(importances: DataFrame, top: int = 20) -> DataFrame:
    """``(rank, feature, importance, cumulative_share)``; one row per feature, so it is small."""
    size = F.abs("importance")
    order = W.orderBy(size.desc(), F.col("feature"))
    total = F.sum(size).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return importances.select(
        F.row_number().over(order).alias("rank"), "feature", "importance",
        _share(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)), total).alias("cumulative_share"),
    ).where(F.col("rank") <= top)


def importance_stats(importances: DataFrame) -> DataFrame:
    v = F.col("importance")
    return importances.agg(F.count("*").alias("n_features"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                           F.max(v).alias("max"), F.min(v).alias("min"))


def results_listing(metrics: DataFrame, names: Sequence[str], importances: DataFrame, top: int = 10) -> DataFrame:
    """Metrics to 4 decimals and the ten largest importances, as ``(section, name, value)``."""
    rows = F.array(*[F.struct(F.lit("metric").alias("section"), F.lit(n).alias("name"),
                              F.round(F.col(n).cast("double"), 4).alias("value")) for n in names])
    best = importances.orderBy(F.desc(F.abs("importance")), "feature").limit(top)
    return metrics.select(F.inline(rows)).unionByName(
        best.select(F.lit("importance").alias("section"), F.col("feature").alias("name"), F.round("importance", 4).alias("value")))


def classification_advice(metrics: DataFrame, limit: int = 5) -> DataFrame:
    c = F.col
    low_recall = (c("precision") > 0.9) & (c("recall") < 0.7)
    return fired(metrics, [
        Rule("advice", "low_accuracy", c("accuracy") < 0.7, c("accuracy")),
        Rule("advice", "too_conservative", low_recall, c("recall")),
        Rule("advice", "too_aggressive", ~low_recall & (c("recall") > 0.9) & (c("precision") < 0.7), c("precision")),
        Rule("advice", "low_f1", c("f1") < 0.6, c("f1")),
    ]).orderBy("ordinal").limit(limit)


def regression_advice(metrics: DataFrame, limit: int = 5) -> DataFrame:
    """Needs ``r2, rmse, mae`` and ``residual_std``."""
    c = F.col
    return fired(metrics, [
        Rule("advice", "low_r2", c("r2") < 0.5, c("r2")),
        Rule("advice", "suspicious_r2", c("r2") > 0.95, c("r2")),
        Rule("advice", "outlier_sensitive", c("rmse") > c("mae") * 2, c("rmse")),
        Rule("advice", "unstable_residuals", c("residual_std") > c("mae") * 2, c("residual_std")),
    ]).orderBy("ordinal").limit(limit)

"""Grid search and ensembles over prepared tables."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, functions as F

from wideloom.operators.evaluate import roc_auc_many
from wideloom.operators.forest import ForestModel
from wideloom.operators.logistic import MOST_FEATURES, fit_folds, margins, packed
from wideloom.operators.models import (
    FEATURES, KEY, LABEL, PREDICTION, PROBABILITIES, SCORE, TREES, Prepared, estimator, fit_forest, metrics_of, score, train_one,
)

MIN_ROWS = 500
FOLDS = 5
MIN_LIFT = 0.05
# The configured grids, by parameter name.
GRIDS: dict[str, dict[str, list]] = {
    "forest": {"trees": [50, 100, 200], "max_depth": [None, 10, 20], "min_split": [2, 5, 10]},
    "gbt": {"maxIter": [50, 100, 200], "maxDepth": [3, 6, 10], "stepSize": [0.01, 0.1, 0.2]},
    "logistic": {"regParam": [10.0, 1.0, 0.1]},
}


def configurations(name: str, grid: Mapping[str, Sequence] | None = None, limit: int | None = None) -> list[dict]:
    """All combinations of a grid, or the first ``limit`` of them."""
    grid = GRIDS.get(name, {}) if grid is None else grid
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())][:limit]


def grid_search(name: str, data: Prepared, grid: Mapping[str, Sequence] | None = None, *, folds: int = FOLDS,
                parallelism: int = 4, min_rows: int = MIN_ROWS, limit: int | None = None) -> tuple[CrossValidatorModel | ForestModel | None, DataFrame]:
    """Cross-validated scores per configuration; a table below ``min_rows`` is not tuned, which a row says."""
    spark = data.train.sparkSession
    schema = "model string, config string, score double"
    rows = data.train.count()
    configs = configurations(name, grid, limit)
    if rows < min_rows:
        return None, spark.createDataFrame([(name, f"not tuned: {rows} rows, {min_rows} needed", None)], schema)
    if not configs:
        return None, spark.createDataFrame([], schema)
    if name == "forest":
        return _forest_grid(data, configs, folds)
    if name == "logistic" and data.task == "classification" and len(data.classes) == 2 and set().union(*configs) == {"regParam"} \
            and len(data.features) <= MOST_FEATURES and min(c["regParam"] for c in configs) > 0:
        return _logistic_grid(data, configs, folds, rows)
    model = estimator(name, data.task, max(len(data.classes), 2), rows)
    maps = [{model.getParam(k): (v / rows if name == "logistic" and k == "regParam" else v) for k, v in c.items()} for c in configs]
    if data.task == "regression":
        judge = RegressionEvaluator(labelCol=LABEL, metricName="r2")
    elif len(data.classes) == 2:
        judge = BinaryClassificationEvaluator(labelCol=LABEL)
    else:
        judge = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="f1")
    search = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, seed=42, parallelism=parallelism)
    fitted = search.fit(data.train)
    found = [(name, ", ".join(f"{k}={v}" for k, v in c.items()), float(s)) for c, s in zip(configs, fitted.avgMetrics)]
    return fitted, spark.createDataFrame(found, schema).orderBy(F.desc("score"))


def _logistic_grid(data: Prepared, configs: Sequence[dict], folds: int, rows: int) -> tuple[CrossValidatorModel, DataFrame]:
    """What ``CrossValidator`` gives on the same folds, with the fits of all folds and penalties in shared passes and exact areas."""
    spark, penalties, width = data.train.sparkSession, [c["regParam"] for c in configs], len(data.features)
    train = data.train.select(F.col(LABEL).cast("double").alias(LABEL), F.floor(F.rand(42) * folds).cast("int").alias("fold"), vector_to_array(FEATURES).alias("x"))
    blocks = packed(train, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = fit_folds(train, blocks, width, folds, penalties)
        areas = np.full((folds, len(configs)), np.nan)   # a fold of one class has none
        names = [f"s{i}" for i in range(len(configs))]
        for fold in range(folds):
            for r in roc_auc_many(margins(blocks, width, fold, found[fold]), LABEL, names).where("roc_auc IS NOT NULL").collect():
                areas[fold, names.index(r["column"])] = r["roc_auc"]
    finally:
        blocks.unpersist()
    kept = areas[~np.isnan(areas).any(1)]
    scores, spread = (kept.mean(0).tolist(), kept.std(0).tolist()) if len(kept) else ([None] * len(configs),) * 2
    place = int(np.argmax(scores)) if len(kept) else 0
    best = estimator("logistic", data.task, 2, rows, regParam=penalties[place] / rows).fit(data.train)
    board = [("logistic", f"regParam={p}", s) for p, s in zip(penalties, scores)]
    fitted = CrossValidatorModel(best, avgMetrics=scores, stdMetrics=spread)
    return fitted, spark.createDataFrame(board, "model string, config string, score double").orderBy(F.desc_nulls_last("score"))


def _forest_grid(data: Prepared, configs: Sequence[dict], folds: int) -> tuple[ForestModel, DataFrame]:
    """Scores of forest configurations: those that differ by the number of trees share one fit per fold, the largest, and
    are scored on its first trees.  A tree does not depend on how many there are, so each score is that of its own fit."""
    metric = "r2" if data.task == "regression" else "roc_auc" if len(data.classes) == 2 else "f1"
    train = data.train.withColumn("_fold", F.pmod(F.xxhash64(KEY), F.lit(folds))).persist()
    groups: dict[tuple, list[dict]] = {}
    for c in configs:
        groups.setdefault(tuple(sorted((k, v) for k, v in c.items() if k != "trees")), []).append(c)
    sums: dict[int, list[float]] = {i: [] for i in range(len(configs))}
    try:
        for same, members in groups.items():
            for fold in range(folds):
                held = Prepared(train.where(F.col("_fold") != fold).drop("_fold"), train.where(F.col("_fold") == fold).drop("_fold"),
                                data.task, data.features, data.classes)
                fitted = fit_forest(held, **dict(same), trees=max(c.get("trees", TREES) for c in members))
                for c in members:
                    found = metrics_of(score(fitted, held.test, trees=c.get("trees", TREES)), data.task, len(data.classes)).get(metric)
                    if found is not None:
                        sums[configs.index(c)].append(found)
    finally:
        train.unpersist()
    rows = [("forest", ", ".join(f"{k}={v}" for k, v in c.items()), sum(v) / len(v) if (v := sums[i]) else None) for i, c in enumerate(configs)]
    best = max(range(len(rows)), key=lambda i: (rows[i][2] is not None, rows[i][2] or 0.0, -i))
    board = data.train.sparkSession.createDataFrame(rows, "model string, config string, score double")
    return fit_forest(data, **configs[best]), board.orderBy(F.desc_nulls_last("score"))


def vote(scored: Sequence[DataFrame], task: str = "classification") -> DataFrame:
    """Average of several models by row key: of the class probabilities (largest wins, the first on ties), or
    of the predictions for a regression.  Models without probabilities, like margins, are refused.
    """
    stacked = None
    for s in scored:
        part = s.select(KEY, LABEL, PREDICTION, PROBABILITIES)
        stacked = part if stacked is None else stacked.unionByName(part)
    if task == "regression":
        return stacked.groupBy(KEY).agg(F.first(LABEL).alias(LABEL), F.avg(PREDICTION).alias(PREDICTION)).withColumn(SCORE, F.col(PREDICTION))
    whole = F.coalesce(F.col(PROBABILITIES), F.raise_error(F.lit("a model without class probabilities cannot vote")).cast("array<double>"))
    long = stacked.select(KEY, LABEL, F.posexplode(whole).alias("c", "p"))
    mean = long.groupBy(KEY, "c").agg(F.first(LABEL).alias(LABEL), F.avg("p").alias("p"))
    best = mean.groupBy(KEY).agg(F.first(LABEL).alias(LABEL), F.max(F.struct("p", (-F.col("c")).alias("c"))).alias("m"),
                                 F.array_sort(F.collect_list(F.struct("c", "p"))).alias("all"))
    mean_all = F.transform("all", lambda x: x["p"])
    return best.select(KEY, LABEL, (-F.col("m.c")).cast("double").alias(PREDICTION), F.get(mean_all, F.lit(1)).alias(SCORE), mean_all.alias(PROBABILITIES))


def stack(names: Sequence[str], data: Prepared, folds: int = FOLDS, **params) -> DataFrame:
    """Scores of a linear model over the out-of-fold outputs of the base models: a logistic one over all class
    probabilities (margins where a model has only these), or least squares over predictions.
    """
    place = F.pmod(F.xxhash64(KEY), F.lit(folds))
    train = data.train.withColumn("_fold", place).persist()
    try:
        base = [_out_of_fold(n, train, data, folds, i, params) for i, n in enumerate(names)]
        held = Prepared(train.drop("_fold"), data.test, data.task, data.features, data.classes)
        meta_train, meta_test = _wide(base), _wide([_outputs(n, held, i, params) for i, n in enumerate(names)])
        columns = [c for c in meta_train.columns if c not in (KEY, LABEL)]
        assemble = VectorAssembler(inputCols=columns, outputCol=FEATURES)
        kind = LinearRegression if data.task == "regression" else LogisticRegression
        meta = kind(labelCol=LABEL, featuresCol=FEATURES).fit(assemble.transform(meta_train))
        return score(meta, assemble.transform(meta_test))
    finally:
        train.unpersist()


def _outputs(name: str, data: Prepared, index: int, params) -> DataFrame:
    """What one model says of each test row: its prediction (regression) or one column per class."""
    scored = train_one(name, data, **params.get(name, {}))[1]
    if data.task == "regression":
        return scored.select(KEY, LABEL, F.col(PREDICTION).alias(f"m{index}"))
    classes = max(len(data.classes), 2)
    said = [F.coalesce(F.get(PROBABILITIES, F.lit(c)), F.when(F.col(PREDICTION) == c, 1.0).otherwise(0.0)) for c in range(1 if classes == 2 else 0, classes)]
    return scored.select(KEY, LABEL, *[v.alias(f"m{index}_{i}") for i, v in enumerate(said)])


def _out_of_fold(name, train, data, folds, index, params) -> DataFrame:
    parts = None
    for k in range(folds):
        piece = Prepared(train.where(F.col("_fold") != k).drop("_fold"), train.where(F.col("_fold") == k).drop("_fold"),
                         data.task, data.features, data.classes)
        scored = _outputs(name, piece, index, params)
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def _wide(parts: Sequence[DataFrame]) -> DataFrame:
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.join(p.drop(LABEL), KEY)
    return wide


def accept(best_single: float, ensemble: float, lift: float = MIN_LIFT) -> bool:
    """Use the ensemble only for a relative gain of at least 5 %."""
    return ensemble >= best_single * (1 + lift)

"""Training, scoring and comparing MLlib models on a prepared table."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wideloom.operators import forest
from wideloom.functions.columns import col, families, melt, number
from wideloom.functions.rules import Rule, fired
from wideloom.operators.counts import lookup
from wideloom.operators.evaluate import binary_metrics, regression_metrics, roc_auc, weighted_metrics
from wideloom.operators.relations import is_classification
from wideloom.operators.running import sorted_index
from wideloom.operators.similarity import NEIGHBOURS, knn_vote
from wideloom.session import cut, ship

# The configured model order per task; the first five are trained.
CLASSIFIERS = ("logistic", "forest", "gbt", "knn", "naive_bayes", "svc")
REGRESSORS = ("linear", "ridge", "lasso", "forest", "gbt")
SEED = 42
TREES = 100
LABEL, FEATURES, PREDICTION, SCORE, KEY = "label", "features", "prediction", "score", "row_key"
PROBABILITIES = "probabilities"
INDEX_LIMIT = 10_000
BOOST_BINS = 32          # MLlib's own number of bins
BIN_ACCURACY = 10_000    # a bin's border is off by at most this part of the rows
CELL_PARAMS = {"maxIter", "maxDepth", "stepSize", "seed"}   # with these, boosting sees no more of a row than its cell


@dataclass(frozen=True)
class Prepared:
    """``train`` and ``test`` with columns row_key, label, features."""

    train: DataFrame
    test: DataFrame
    task: str
    features: list[str]
    classes: list[str]


@dataclass(frozen=True)
class Trained:
    name: str
    model: Model | None
    metrics: dict[str, float]
    seconds: float
    importances: dict[str, float] = field(default_factory=dict)
    error: str = ""


def class_list(df: DataFrame, target: str, limit: int = INDEX_LIMIT) -> list[str] | None:
    """Classes in index order (numbers by value, nulls as ``missing``); None beyond ``limit``."""
    y = F.coalesce(col(target).cast("string"), F.lit("missing"))
    found = [r["y"] for r in df.select(y.alias("y")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        return None
    numeric = target in families(df).numeric
    return sorted(found, key=lambda v: (v == "missing", float(v), "") if numeric and v != "missing" else (numeric, 0.0, v))


def _class_index(target: str, classes: Sequence[str]) -> Column:
    y = F.coalesce(col(target).cast("string"), F.lit("missing"))
    index = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return F.try_element_at(index, y)


def encode_target(df: DataFrame, target: str, out: str = LABEL) -> tuple[DataFrame, list[str]]:
    """Class index in sorted order (numbers by value, nulls last), the same however many classes there are.

    The class list is empty when it is too long for the driver; the index is then a distributed sort.
    """
    classes = class_list(df, target)
    if classes is None and target in families(df).numeric:
        counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("_key")).agg(F.count("*").alias("_count"))
        keyed = lookup(df.withColumn("_key", col(target)), "_key", sorted_index(counts, "_key", "_code"), "_count", F.lit(counts.count()), "_code")
        return keyed.select(*[col(c) for c in df.columns if c != out], F.col("_code").cast("double").alias(out)), []
    if classes is None:
        filled = df.withColumn("_target", F.coalesce(col(target).cast("string"), F.lit("missing")))
        return label_encode(filled, "_target", out).withColumn(out, F.col(out).cast("double")).drop("_target"), []
    return df.withColumn(out, _class_index(target, classes)), classes


def label_encode(df: DataFrame, name: str, out: str) -> DataFrame:
    """Index of a text feature in sorted order; nulls read as the text ``nan``.

    The index is a distributed sort of the distinct values, so any cardinality works.
    """
    text = F.coalesce(col(name).cast("string"), F.lit("nan"))
    counts = df.groupBy(text.alias("_key")).agg(F.count("*").alias("_count"))
    joined = lookup(df.withColumn("_key", text), "_key", sorted_index(counts, "_key", "_code"), "_count", F.lit(0), "_code")
    return joined.select(*[col(c) for c in df.columns], F.col("_code").alias(out))


def fit_means(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    rows = melt(df, [[number(df, n)] for n in names], ["x"]).groupBy("ci").agg(F.avg("x").alias("m")).collect()
    return {names[r["ci"]]: r["m"] for r in rows if r["m"] is not None}


def prepare(train: DataFrame, test: DataFrame, target: str, keys: Sequence[str], *, task: str | None = None,
            whole_table: DataFrame | None = None) -> Prepared:
    """Impute by means, index the target and assemble vectors.

    Means come from the training rows; pass ``whole_table`` to take them from all rows.
    """
    fit_on = whole_table if whole_table is not None else train
    names = [c for c in families(train).numeric if c != target and c not in keys]
    means = fit_means(fit_on, names)
    classify = is_classification(fit_on, target, task)
    classes: list[str] = []
    if classify:
        classes = class_list(fit_on, target)
        if classes is None:
            raise ValueError(f"{target} has more than {INDEX_LIMIT} classes, too many to train a classifier")
    else:
        fill = fit_on.agg(F.avg(number(fit_on, target))).head()[0]

    def ready(df: DataFrame) -> DataFrame:
        if classify:
            label = _class_index(target, classes)
        else:
            label = F.coalesce(number(df, target), F.lit(fill))
        key = F.concat_ws("|", *[col(k).cast("string") for k in keys])
        return df.select(key.alias(KEY), label.alias(LABEL),
                         *[F.coalesce(number(df, n), F.lit(means.get(n, 0.0))).alias(n) for n in names]).where(F.col(LABEL).isNotNull())

    assemble = VectorAssembler(inputCols=names, outputCol=FEATURES)
    parts = [assemble.transform(ready(d)).select(KEY, LABEL, FEATURES) for d in (train, test)]
    return Prepared(*parts, "classification" if classify else "regression", names, classes)


def balanced(data: Prepared, out: str = "weight") -> Prepared:
    """Training rows weighted by n / (classes x class count); train with ``weight="weight"``."""
    counts = {r[LABEL]: r["n"] for r in data.train.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col(LABEL) == F.lit(label), F.lit(total / (len(counts) * n))).otherwise(weight)
    return Prepared(data.train.withColumn(out, weight), data.test, data.task, data.features, data.classes)


def estimator(name: str, task: str, classes: int = 2, rows: int = 1, label_std: float = 1.0, weight: str | None = None, **params):
    """The MLlib estimator behind a configured model name; forests have their own trainer, ``fit_forest``.

    MLlib averages the loss over the ``rows`` training rows, so penalties stated for a summed
    loss are divided by that number.  It also scales the label, which a squared penalty has to
    make up for with ``label_std``.
    """
    cols = {"labelCol": LABEL, "featuresCol": FEATURES}
    weighted = {"weightCol": weight} if weight else {}
    if task == "classification":
        if name == "logistic":
            return LogisticRegression(**cols, **weighted, **{"maxIter": 1000, "regParam": 1.0 / rows, "standardization": False, **params})
        if name == "gbt":
            one = GBTClassifier(**cols, **weighted, **{"maxIter": TREES, "maxDepth": 3, "stepSize": 0.1, "seed": SEED, **params})
            return one if classes <= 2 else OneVsRest(classifier=one, **cols, **weighted)
        if name == "naive_bayes":
            return NaiveBayes(modelType="gaussian", **cols, **weighted, **params)
        if name == "svc":
            one = LinearSVC(**cols, **weighted, **{"maxIter": 100, "regParam": 0.01, **params})
            return one if classes <= 2 else OneVsRest(classifier=one, **cols, **weighted)
    else:
        if name == "gbt":
            return GBTRegressor(**cols, **weighted, **{"maxIter": TREES, "maxDepth": 3, "stepSize": 0.1, "seed": SEED, **params})
        if name in ("linear", "ridge", "lasso"):
            penalty, mix = {"linear": (0.0, 0.0), "ridge": (label_std / rows, 0.0), "lasso": (1.0, 1.0)}[name]
            return LinearRegression(**cols, **weighted, **{"regParam": penalty, "elasticNetParam": mix, "standardization": False, **params})
    raise ValueError(f"no {task} model named {name}")


def shortlist(task: str, wanted: Sequence[str] | None = None, limit: int | None = None) -> list[str]:
    """The wanted or all models of the task, at most ``limit`` of them."""
    return list(wanted or (CLASSIFIERS if task == "classification" else REGRESSORS))[:limit]


def score(model: Model | forest.ForestModel, df: DataFrame, **params) -> DataFrame:
    """``(row_key, label, prediction, score, probabilities)``; score is P(class 1) where the model has one."""
    out = model.transform(df, **params)
    every = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    if "probability" in out.columns:
        value = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        value = vector_to_array("rawPrediction")[1]
    else:
        value = F.col(PREDICTION)
    return out.select(KEY, LABEL, F.col(PREDICTION).cast("double").alias(PREDICTION), value.cast("double").alias(SCORE), every.alias(PROBABILITIES))


def metrics_of(scored: DataFrame, task: str, classes: int = 2) -> dict[str, float]:
    if task == "regression":
        return regression_metrics(scored).select("r2", "mse", "rmse", "mae").head().asDict()
    table = binary_metrics(scored) if classes <= 2 else weighted_metrics(scored)
    found = table.select("accuracy", "precision", "recall", "f1").head().asDict()
    if classes == 2:
        area = roc_auc(scored).head()[0]
        if area is not None:
            found["roc_auc"] = area
    return found


def feature_importance(model: Model, names: Sequence[str]) -> dict[str, float]:
    if hasattr(model, "featureImportances"):
        return dict(zip(names, (float(v) for v in model.featureImportances.toArray())))
    if hasattr(model, "coefficientMatrix"):
        return dict(zip(names, (float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0))))
    if hasattr(model, "coefficients"):
        return dict(zip(names, (abs(float(v)) for v in model.coefficients.toArray())))
    return {}


def fit_forest(data: Prepared, *, weight: str | None = None, trees: int = TREES, features: str | int | None = None, seed: int = SEED,
               **params) -> forest.ForestModel:
    """A forest without a limit of depth: the root of the features are tried at a node of a classifier, all for a regression."""
    classify = data.task == "classification"
    spec = forest.Spec(trees=trees, features=features or ("sqrt" if classify else "all"), seed=seed, **params)
    return forest.fit(data.train, max(len(data.classes), 2) if classify else 0, len(data.features), spec, weight)


def bin_values(train: DataFrame, bins: int = BOOST_BINS) -> list[np.ndarray]:
    """Per feature the values that stand for its bins, from all rows: every value if there are few, or quantiles; MLlib cuts in the middle between two."""
    width = train.select(F.max(F.size(vector_to_array(FEATURES)))).head()[0] or 0
    x = train.select(*[F.get(vector_to_array(FEATURES), F.lit(i)).alias(f"x{i}") for i in range(width)])
    shares = [(i + 0.5) / bins for i in range(bins)]
    facts = x.agg(*[f(f"x{i}") for i in range(width) for f in (F.approx_count_distinct, lambda c: F.percentile_approx(c, shares, BIN_ACCURACY))]).head() if width else ()
    found = []
    for i in range(width):
        values = [r[0] for r in x.select(f"x{i}").distinct().limit(bins + 1).collect()] if facts[2 * i] <= 2 * bins else []
        found.append(np.unique(np.array(values if 0 < len(values) <= bins else facts[2 * i + 1], np.float64)))
    return found


def boosting_cells(train: DataFrame, values: Sequence[np.ndarray], classify: bool, weight: str | None = None) -> DataFrame:
    """``(label, features, _weight)``: rows that share all their bins (and, for a classifier, the label) as one row with their weight and mean label.

    Histogram boosting gives such rows the same score in every round, and its loss needs no more of them than these sums.
    """
    cuts = [(v[1:] + v[:-1]) / 2.0 for v in values]

    def code(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            codes = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.uint16)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(cuts)), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(1), batch.column(2)], ["code", LABEL, "w"])

    def decode(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(batch.num_rows, len(values))
            x = np.stack([v[codes[:, i]] for i, v in enumerate(values)], 1)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(values)).cast(pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                                             ["x", LABEL, "_weight"])
    ship(train.sparkSession)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    coded = train.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias(LABEL), w.alias("w")).where("w > 0") \
        .mapInArrow(code, f"code binary, {LABEL} double, w double")
    summed = coded.groupBy("code", *([LABEL] if classify else [])).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(LABEL)).alias("wy"))
    parts = train.sparkSession.sparkContext.defaultParallelism
    cells = summed.select("code", (F.col("wy") / F.col("w")).alias(LABEL), "w").repartition(parts, "code").sortWithinPartitions("code", LABEL)
    return cut(cells.mapInArrow(decode, f"x array<double>, {LABEL} double, _weight double").select(LABEL, array_to_vector("x").alias(FEATURES), "_weight"))


def fit_boosted(data: Prepared, rows: int, weight: str | None = None, **params) -> PipelineModel:
    """Boosted trees on the cells of the bins where these are at most half as many as the rows, else on the rows."""
    classes = max(len(data.classes), 2)
    classify = data.task == "classification"
    values = bin_values(data.train) if set(params) <= CELL_PARAMS else []
    if not values or math.prod(map(len, values)) * (classes if classify else 1) > rows / 2:
        return Pipeline(stages=[estimator("gbt", data.task, classes, rows, weight=weight, **params)]).fit(data.train)
    # One bin more than values: MLlib may add a zero that the cells lack.
    model_in = estimator("gbt", data.task, classes, rows, weight="_weight", maxBins=BOOST_BINS + 1, **params)
    return Pipeline(stages=[model_in]).fit(boosting_cells(data.train, values, classify, weight))


def knn_scores(data: Prepared) -> DataFrame:
    """Votes of the nearest training rows, ties to the smaller key.

    Test rows of equal features have the same neighbours and are looked up as one; of equal training rows only the
    first by key can be among them.  Keys need not be unique.
    """
    rows = lambda d: d.select(F.col(KEY), F.col(LABEL), vector_to_array(FEATURES).alias("embedding"))
    nth = F.row_number().over(W.partitionBy("embedding").orderBy(KEY, LABEL))
    first = rows(data.train).withColumn("nth", nth).where(F.col("nth") <= NEIGHBOURS)
    name = F.concat_ws("\0", KEY, F.hex(F.xxhash64("embedding")), F.col("nth").cast("string"))   # unique, in the order of the keys
    base = cut(first.select(name.alias("id"), LABEL, "embedding"))
    asked = cut(rows(data.test).select("embedding").distinct().withColumn("query_id", F.monotonically_increasing_id()))
    votes = asked.join(knn_vote(asked, base, LABEL), "query_id").select("embedding", F.col("prediction").cast("double").alias(PREDICTION))
    return rows(data.test).join(votes, "embedding").select(
        KEY, LABEL, PREDICTION, F.lit(None).cast("double").alias(SCORE), F.lit(None).cast("array<double>").alias(PROBABILITIES))


def train_one(name: str, data: Prepared, **params) -> tuple[PipelineModel | forest.ForestModel | None, DataFrame]:
    """Fit one model and score the test rows."""
    if name == "forest":
        fitted = fit_forest(data, **params)
        return fitted, score(fitted, data.test)
    if name == "knn":
        return None, knn_scores(data)
    steps = []
    rows, std = data.train.agg(F.count("*"), F.stddev_pop(LABEL)).head()
    if name == "gbt":
        fitted = fit_boosted(data, rows, **params)
        return fitted, score(fitted, data.test)
    model_in = estimator(name, data.task, max(len(data.classes), 2), max(rows, 1), std or 1.0, **params)
    if name == "svc":
        scaler = StandardScaler(inputCol=FEATURES, outputCol="scaled", withMean=True)
        model_in = model_in.copy()
        model_in.setFeaturesCol("scaled")
        steps.append(scaler)
    fitted = Pipeline(stages=[*steps, model_in]).fit(data.train)
    return fitted, score(fitted, data.test)


def _spread(df: DataFrame) -> DataFrame:
    """At least one partition per core: every iteration of a fit runs over all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, KEY)


def train_models(data: Prepared, names: Sequence[str] | None = None, **params) -> list[Trained]:
    """Train the shortlist on a cached table; a model that fails is kept with its error, and if all fail, the last error is raised."""
    out: list[Trained] = []
    failed: Exception | None = None
    train, test = _spread(data.train).persist(), data.test.persist()
    held = Prepared(train, test, data.task, data.features, data.classes)
    try:
        for name in names or shortlist(data.task):
            start = time.monotonic()
            try:
                fitted, scored = train_one(name, held, **params)
                kept = scored.select(LABEL, PREDICTION, SCORE).persist()   # several passes look at the scores
                try:
                    metrics = metrics_of(kept, data.task, len(data.classes))
                finally:
                    kept.unpersist()
                last = fitted.stages[-1] if isinstance(fitted, PipelineModel) else fitted
                out.append(Trained(name, fitted, metrics, time.monotonic() - start,
                                   feature_importance(last, data.features) if last is not None else {}))
            except Exception as problem:  # one failing model must not stop the others
                failed = problem
                out.append(Trained(name, None, {}, time.monotonic() - start, error=str(problem)[:500] or type(problem).__name__))
    finally:
        train.unpersist()
        test.unpersist()
    if failed is not None and all(t.error for t in out):
        raise RuntimeError(f"no model could be trained: {', '.join(t.name for t in out)}") from failed
    return out


LEADERBOARD = ("model string, accuracy double, precision double, recall double, f1 double, roc_auc double, "
               "r2 double, mse double, rmse double, mae double, seconds double, error string")


def leaderboard_frame(spark, results: Sequence[Trained]) -> DataFrame:
    names = [c.split(" ")[0] for c in LEADERBOARD.split(", ")][1:-2]
    rows = [(t.name, *[t.metrics.get(m) for m in names], t.seconds, t.error) for t in results]
    return spark.createDataFrame(rows, LEADERBOARD)


def primary_metric(task: str):
    if task == "classification":
        return F.coalesce(F.col("roc_auc"), F.col("f1"), F.col("accuracy"), F.lit(0.0))
    return F.coalesce(F.col("r2"), -F.col("mae"), F.lit(0.0))


def leaderboard(board: DataFrame, task: str) -> DataFrame:
    """Board with ``primary_metric`` and ``rank``; it has one row per model."""
    metric = primary_metric(task)
    return board.withColumn("primary_metric", metric).withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("primary_metric"), "model")))


def best_model(board: DataFrame, task: str) -> DataFrame:
    """The winner by the first metric any model has: roc_auc, f1, accuracy; or r2, then low mae."""
    order = ["roc_auc", "f1", "accuracy"] if task == "classification" else ["r2"]
    has = board.agg(*[F.count(m).alias(m) for m in order]).head()
    metric = next((m for m in order if has[m]), None)
    if metric:
        ranked = board.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), "model")
    elif task == "regression":
        ranked = board.where("mae IS NOT NULL").orderBy("mae", "model")
    else:
        ranked = board.orderBy("model")
    return ranked.limit(1)


def close_race(ranked: DataFrame, gap: float = 0.02) -> DataFrame:
    """The top two models when their primary metrics differ by less than ``gap``."""
    top = ranked.where("rank <= 2").agg(
        F.max_by("model", -F.col("rank")).alias("best"), F.max_by("model", "rank").alias("second"),
        (F.max("primary_metric") - F.min("primary_metric")).alias("gap"), F.count("*").alias("n"))
    return top.where((F.col("n") == 2) & (F.col("gap") < gap)).select("best", "second", "gap")


def model_advice(ranked: DataFrame, task: str) -> DataFrame:
    summary = ranked.agg(F.max("primary_metric").alias("best"), F.sum("seconds").alias("seconds"), F.count("*").alias("models"))
    c = F.col
    rules = [
        Rule("suggestion", "moderate_score", c("best") < 0.7, c("best")),
        Rule("suggestion", "suspiciously_high", c("best") > 0.95, c("best")),
    ] if task == "classification" else [Rule("suggestion", "low_r2", c("best") < 0.5, c("best"))]
    return fired(summary, [
        *rules,
        Rule("suggestion", "long_training", c("seconds") > 300, c("seconds")),
        Rule("suggestion", "few_models", c("models") < 3, c("models")),
    ])


def save_model(model: PipelineModel | forest.ForestModel, path: str) -> str:
    if isinstance(model, forest.ForestModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str, kind: str = "") -> PipelineModel | forest.ForestModel:
    """A saved model; ``kind="forest"`` for forests, which have a format of their own."""
    return forest.ForestModel.load(SparkSession.active(), path) if kind == "forest" else PipelineModel.load(path)

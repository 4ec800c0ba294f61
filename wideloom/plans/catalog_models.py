"""Queries: evaluation, splits, models, ensembles and the whole flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideloom.operators import evaluate, models, split, tuning
from wideloom.plans import flow
from wideloom.plans.inputs import CLASSES, FITTED, LABELLED, SCORED
from wideloom.plans.registry import query, rounded, table, union_sql
from wideloom.session import cut

# Metrics ---------------------------------------------------------------------------------------

def _binary_sql(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}n, round(hit * 1.0 / n, 6) AS accuracy, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) AS precision,
 round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (
 SELECT {lead}count(*) AS n, count(*) FILTER (label = prediction) AS hit, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
 count(*) FILTER (label <> 1 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction <> 1) AS fn FROM {source} {group}) c"""


METRICS = ("accuracy", "precision", "recall", "f1")


@query("cls_metrics", f"WITH v AS ({SCORED.sql}) " + _binary_sql("v"))
def cls_metrics(spark, d):
    return rounded(evaluate.binary_metrics(SCORED.frame(spark, d)), 6, *METRICS)


@query("cls_metrics_labels", f"WITH v AS ({LABELLED.sql}) " + _binary_sql("v"))
def cls_metrics_labels(spark, d):
    return rounded(evaluate.binary_metrics(LABELLED.frame(spark, d)), 6, *METRICS)


_REPORT = f"""
k AS (SELECT DISTINCT label AS c FROM v UNION SELECT DISTINCT prediction FROM v),
t AS (SELECT c, (SELECT count(*) FROM v WHERE label = c) AS support, (SELECT count(*) FROM v WHERE prediction = c) AS predicted,
      (SELECT count(*) FROM v WHERE label = c AND prediction = c) AS tp FROM k),
p AS (SELECT c, support, tp, coalesce(tp * 1.0 / nullif(predicted, 0), 0) AS precision, coalesce(tp * 1.0 / nullif(support, 0), 0) AS recall FROM t),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p)"""


@query("class_report", f"""WITH v AS ({CLASSES.sql}), {_REPORT}
SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) * 1.0 / sum(support), 6), round(sum(tp) * 1.0 / sum(support), 6), round(sum(tp) * 1.0 / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def class_report(spark, d):
    return rounded(evaluate.class_report(CLASSES.frame(spark, d)), 6, "precision", "recall", "f1")


@query("cls_metrics_weighted", f"""WITH v AS ({CLASSES.sql}), {_REPORT}
SELECT round(sum(tp) * 1.0 / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
 round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM f""")
def cls_metrics_weighted(spark, d):
    return rounded(evaluate.weighted_metrics(CLASSES.frame(spark, d)), 6, *METRICS)


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS cnt FROM ({CLASSES.sql}) v GROUP BY label, prediction")
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(CLASSES.frame(spark, d))


@query("class_distributions", f"WITH v AS ({CLASSES.sql}) SELECT 'label' AS side, CAST(label AS VARCHAR) AS value, count(*) AS cnt FROM v GROUP BY label "
       "UNION ALL SELECT 'prediction', CAST(prediction AS VARCHAR), count(*) FROM v GROUP BY prediction")
def class_distributions(spark, d):
    return evaluate.distributions(CLASSES.frame(spark, d))


def _auc_sql(source: str) -> str:
    return (f"SELECT (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * 1.0 * sum(1 - label)) AS roc_auc FROM ("
            f"SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {source}) t")


@query("roc_auc", f"WITH v AS ({SCORED.sql}), w AS ({LABELLED.sql}) SELECT 'lineitem' AS source, round(roc_auc, 8) AS roc_auc FROM ({_auc_sql('v')}) a "
       f"UNION ALL SELECT 'labels', round(roc_auc, 8) FROM ({_auc_sql('w')}) b")
def roc_auc(spark, d):
    one = evaluate.roc_auc(SCORED.frame(spark, d)).select(F.lit("lineitem").alias("source"), "roc_auc")
    two = evaluate.roc_auc(LABELLED.frame(spark, d)).select(F.lit("labels").alias("source"), "roc_auc")
    return rounded(one.unionByName(two), 8, "roc_auc")


_SWEEP = """s AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM v GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
      sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""


@query("roc_curve", f"WITH v AS ({SCORED.sql}), {_SWEEP} SELECT score AS threshold, round(fp * 1.0 / n, 6) AS fpr, round(tp * 1.0 / p, 6) AS tpr FROM c")
def roc_curve(spark, d):
    return rounded(evaluate.roc_curve(SCORED.frame(spark, d)), 6, "fpr", "tpr")


@query("pr_curve", f"WITH v AS ({SCORED.sql}), {_SWEEP} SELECT score AS threshold, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / p, 6) AS recall FROM c")
def pr_curve(spark, d):
    return rounded(evaluate.pr_curve(SCORED.frame(spark, d)), 6, "precision", "recall")


@query("curve_areas", f"""WITH v AS ({SCORED.sql}), {_SWEEP},
e AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS fp0 FROM c)
SELECT round(sum((fp - fp0) * (tp + tp0) / 2.0) / (max(p) * 1.0 * max(n)), 6) AS roc_area,
 round(sum((tp - tp0) * (tp * 1.0 / (tp + fp) + CASE WHEN tp0 + fp0 = 0 THEN 1.0 ELSE tp0 * 1.0 / (tp0 + fp0) END) / 2.0) / max(p), 6) AS pr_area FROM e""")
def curve_areas(spark, d):
    return rounded(evaluate.curve_areas(SCORED.frame(spark, d)), 6, "roc_area", "pr_area")


@query("threshold_sweep", f"""WITH v AS ({SCORED.sql}), {_SWEEP},
m AS (SELECT score, round(2.0 * tp / (tp + fp + p), 12) AS f1, round(tp * 1.0 / p - fp * 1.0 / n, 12) AS youden FROM c)
SELECT (SELECT score FROM m ORDER BY f1 DESC, score DESC LIMIT 1) AS f1_threshold, round((SELECT max(f1) FROM m), 6) AS best_f1,
 (SELECT score FROM m ORDER BY youden DESC, score DESC LIMIT 1) AS youden_threshold, round((SELECT max(youden) FROM m), 6) AS best_youden""")
def threshold_sweep(spark, d):
    return rounded(evaluate.threshold_sweep(SCORED.frame(spark, d)), 6, "best_f1", "best_youden")


_REG = """SELECT part, count(*) AS n, 1 - sum(power(label - prediction, 2)) / (var_pop(label) * count(*)) AS r2, avg(power(label - prediction, 2)) AS mse,
 sqrt(avg(power(label - prediction, 2))) AS rmse, avg(abs(label - prediction)) AS mae FROM v GROUP BY part"""


@query("reg_metrics", f"WITH v AS ({FITTED.sql}) SELECT part, n, round(r2, 6) AS r2, round(mse, 2) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae FROM ({_REG}) t")
def reg_metrics(spark, d):
    out = evaluate.regression_metrics(FITTED.frame(spark, d), by=["part"])
    return rounded(rounded(rounded(out, 6, "r2"), 2, "mse"), 4, "rmse", "mae")


@query("residual_stats", f"""WITH v AS (SELECT label - prediction AS r FROM ({FITTED.sql}) f)
SELECT round(avg(r), 4) AS mean, round(stddev_pop(r), 4) AS std, round(min(r), 4) AS min, round(max(r), 4) AS max,
 round(quantile_cont(r, 0.25), 4) AS q25, round(quantile_cont(r, 0.75), 4) AS q75 FROM v""")
def residual_stats(spark, d):
    return rounded(evaluate.residual_stats(FITTED.frame(spark, d)), 4, "mean", "std", "min", "max", "q25", "q75")


@query("residual_pairs", f"SELECT prediction, round(label - prediction, 4) AS residual FROM ({FITTED.sql}) f")
def residual_pairs(spark, d):
    return rounded(evaluate.residual_pairs(FITTED.frame(spark, d)), 4, "residual")


@query("pred_stability", f"SELECT round(avg(prediction), 4) AS mean, round(stddev_pop(prediction), 4) AS std, round(stddev_pop(prediction) / (avg(prediction) + 1e-8), 6) AS cv "
       f"FROM ({FITTED.sql}) f HAVING count(*) > 10")
def pred_stability(spark, d):
    return rounded(rounded(evaluate.prediction_stability(FITTED.frame(spark, d)), 4, "mean", "std"), 6, "cv")


IMPORTANCE_COLUMNS = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey")
_IMPORTANCE = union_sql(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS importance FROM lineitem" for c in IMPORTANCE_COLUMNS)


def _importances(spark, d):
    from wideloom.operators.relations import target_correlations
    found = target_correlations(table(spark, d, "lineitem"), "l_extendedprice", IMPORTANCE_COLUMNS)
    return found.select(F.col("column").alias("feature"), F.col("correlation").alias("importance"))


@query("importance_share", f"""WITH i AS ({_IMPORTANCE}) SELECT rank, feature, round(importance, 6) AS importance, round(cs / tot, 6) AS cumulative_share FROM (
 SELECT feature, importance, row_number() OVER (ORDER BY abs(importance) DESC, feature) AS rank,
 sum(abs(importance)) OVER (ORDER BY abs(importance) DESC, feature) AS cs, sum(abs(importance)) OVER () AS tot FROM i) t WHERE rank <= 20""")
def importance_share(spark, d):
    return rounded(evaluate.importance_share(_importances(spark, d)), 6, "importance", "cumulative_share")


@query("importance_stats", f"WITH i AS ({_IMPORTANCE}) SELECT count(*) AS n_features, round(avg(importance), 6) AS mean, round(stddev_pop(importance), 6) AS std, "
       "round(max(importance), 6) AS max, round(min(importance), 6) AS min FROM i")
def importance_stats(spark, d):
    return rounded(evaluate.importance_stats(_importances(spark, d)), 6, "mean", "std", "max", "min")


@query("results_listing", f"WITH v AS ({SCORED.sql}), i AS ({_IMPORTANCE}), m AS ({_binary_sql('v')}) " + union_sql(
    f"SELECT 'metric' AS section, '{m}' AS name, round({m}, 4) AS value FROM m" for m in METRICS) +
    " UNION ALL SELECT * FROM (SELECT 'importance', feature, round(importance, 4) FROM i ORDER BY abs(importance) DESC, feature LIMIT 10) t")
def results_listing(spark, d):
    return evaluate.results_listing(evaluate.binary_metrics(SCORED.frame(spark, d)), METRICS, _importances(spark, d))


@query("classification_advice", f"WITH v AS ({SCORED.sql}), m AS ({_binary_sql('v')}) " + union_sql([
    "SELECT 'low_accuracy' AS code, round(accuracy, 6) AS value FROM m WHERE accuracy < 0.7",
    "SELECT 'too_conservative', round(recall, 6) FROM m WHERE precision > 0.9 AND recall < 0.7",
    "SELECT 'too_aggressive', round(precision, 6) FROM m WHERE recall > 0.9 AND precision < 0.7",
    "SELECT 'low_f1', round(f1, 6) FROM m WHERE f1 < 0.6"]))
def classification_advice(spark, d):
    return rounded(evaluate.classification_advice(evaluate.binary_metrics(SCORED.frame(spark, d))).select("code", "value"), 6, "value")


@query("regression_advice", f"""WITH v AS (SELECT label, prediction, 'all' AS part FROM ({FITTED.sql}) f), m AS ({_REG}), s AS (SELECT stddev_pop(label - prediction) AS sd FROM v) """ + union_sql([
    "SELECT 'low_r2' AS code, round(r2, 4) AS value FROM m WHERE r2 < 0.5", "SELECT 'suspicious_r2', round(r2, 4) FROM m WHERE r2 > 0.95",
    "SELECT 'outlier_sensitive', round(rmse, 4) FROM m WHERE rmse > mae * 2", "SELECT 'unstable_residuals', round(sd, 4) FROM m, s WHERE sd > mae * 2"]))
def regression_advice(spark, d):
    df = FITTED.frame(spark, d)
    deviation = evaluate.residual_stats(df).select("std").scalar()
    metrics = evaluate.regression_metrics(df).withColumn("residual_std", deviation)
    return rounded(evaluate.regression_advice(metrics).select("code", "value"), 4, "value")


# Boards ----------------------------------------------------------------------------------------

_BOARD = f"SELECT part AS model, accuracy, precision, recall, f1 FROM ({_binary_sql('v', 'part')}) b"


def _board(spark, d):
    """Each return flag plays one model; its metrics come from the whole table."""
    found = evaluate.binary_metrics(SCORED.frame(spark, d), by=["part"])
    return found.select(F.col("part").alias("model"), "accuracy", "precision", "recall", "f1", F.lit(None).cast("double").alias("roc_auc"), F.lit(1.0).alias("seconds"))


@query("leaderboard", f"WITH v AS ({SCORED.sql}), b AS ({_BOARD}) SELECT model, round(f1, 6) AS primary_metric, row_number() OVER (ORDER BY f1 DESC, model) AS rank FROM b")
def leaderboard(spark, d):
    return rounded(models.leaderboard(_board(spark, d), "classification").select("model", "primary_metric", "rank"), 6, "primary_metric")


@query("leaderboard_best", f"WITH v AS ({SCORED.sql}), b AS ({_BOARD}) SELECT model, round(f1, 6) AS f1 FROM b ORDER BY f1 DESC, model LIMIT 1")
def leaderboard_best(spark, d):
    return rounded(models.best_model(_board(spark, d), "classification").select("model", "f1"), 6, "f1")


@query("leaderboard_close_race", f"""WITH v AS ({SCORED.sql}), b AS ({_BOARD}), r AS (SELECT model, f1, row_number() OVER (ORDER BY f1 DESC, model) AS k FROM b)
SELECT a.model AS best, c.model AS second, round(a.f1 - c.f1, 6) AS gap FROM r a, r c WHERE a.k = 1 AND c.k = 2 AND a.f1 - c.f1 < 0.02""")
def leaderboard_close_race(spark, d):
    return rounded(models.close_race(models.leaderboard(_board(spark, d), "classification")), 6, "gap")


@query("leaderboard_best_regression", f"WITH v AS ({FITTED.sql}), m AS ({_REG}) SELECT part AS model, round(r2, 6) AS r2 FROM m ORDER BY r2 DESC, part LIMIT 1")
def leaderboard_best_regression(spark, d):
    board = evaluate.regression_metrics(FITTED.frame(spark, d), by=["part"]).withColumnRenamed("part", "model")
    return rounded(models.best_model(board, "regression").select("model", "r2"), 6, "r2")


@query("model_advice", f"WITH v AS ({SCORED.sql}), b AS ({_BOARD}), s AS (SELECT max(f1) AS best, count(*) AS n FROM b) "
       "SELECT 'moderate_score' AS code, round(best, 6) AS value FROM s WHERE best < 0.7 UNION ALL SELECT 'suspiciously_high', round(best, 6) FROM s WHERE best > 0.95 "
       "UNION ALL SELECT 'few_models', CAST(n AS DOUBLE) FROM s WHERE n < 3")
def model_advice(spark, d):
    return rounded(models.model_advice(models.leaderboard(_board(spark, d), "classification"), "classification").select("code", "value"), 6, "value")


# Splits and targets ----------------------------------------------------------------------------

_SPLIT = """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR)))) <=
 floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2 + 0.5) AS is_test FROM orders"""


@query("split_stratified", _SPLIT)
def split_stratified(spark, d):
    return split.with_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query("split_random", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
       "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))), l_orderkey, l_linenumber, l_partkey, l_suppkey) <= floor(count(*) OVER () * 0.2 + 0.5) AS is_test FROM lineitem")
def split_random(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return split.with_split(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("split_sizes", f"SELECT o_orderstatus, count(*) FILTER (NOT is_test) AS train_rows, count(*) FILTER (is_test) AS test_rows FROM ({_SPLIT}) s GROUP BY o_orderstatus")
def split_sizes(spark, d):
    return split.split_sizes(split_stratified(spark, d), "o_orderstatus")


@query("task_type", "SELECT 'events' AS source, 'classification' AS task FROM events HAVING count(*) > 0 UNION ALL "
       "SELECT 'orders', CASE WHEN count(DISTINCT o_totalprice) < 20 THEN 'classification' ELSE 'regression' END FROM orders UNION ALL "
       "SELECT 'part', CASE WHEN count(DISTINCT p_size) < 20 THEN 'classification' ELSE 'regression' END FROM part")
def task_type(spark, d):
    from wideloom.operators.relations import is_classification
    rows = [(t, "classification" if is_classification(table(spark, d, t), c) else "regression")
            for t, c in (("events", "event_type"), ("orders", "o_totalprice"), ("part", "p_size"))]
    return spark.createDataFrame(rows, "source string, task string")


@query("encode_target", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY coalesce(s, 'missing')) - 1 AS DOUBLE) AS label FROM "
       "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE lower(o_orderstatus) END AS s FROM orders) t")
def encode_target(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.lower("o_orderstatus")).alias("s"))
    return models.encode_target(df, "s")[0].select("o_orderkey", "label")


@query("class_weights", "SELECT event_type AS class, count(*) AS cnt, round((SELECT count(*) FROM events) * 1.0 / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 6) AS weight FROM events GROUP BY event_type")
def class_weights(spark, d):
    return rounded(split.class_weights(table(spark, d, "events"), "event_type"), 6, "weight")


# Training: no SQL for these, only rows are checked ----------------------------------------------

def _prepared(spark, d, target: str, task: str):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_quantity") * 1000 + F.col("l_discount") * 5000 + F.col("l_partkey") % 97 * 100 > 31000).cast("int").alias("big"),
        (F.col("l_quantity") * 900 + F.col("l_discount") * 20000 + F.col("l_partkey") % 97 * 100).alias("cost"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax"]
    df = df.withColumn("row_key", split.shuffle_key(keys)).select("row_key", "l_quantity", "l_discount", "l_tax", "l_extendedprice", target)
    marked = cut(split.with_split(df, ["row_key"], target if task == "classification" else None))
    train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    return models.prepare(train, test, target, ["row_key"], task=task)


def _train(name: str, task: str, **params):
    target = "big" if task == "classification" else "cost"

    def run(spark, d):
        data = _prepared(spark, d, target, task)
        return models.leaderboard_frame(spark, models.train_models(data, [name], **params)).drop("seconds")
    return run


for _name, _model, _task, _params in (
    ("train_logistic", "logistic", "classification", {}), ("train_forest", "forest", "classification", {}),
    ("train_gbt", "gbt", "classification", {}), ("train_nb", "naive_bayes", "classification", {}),
    ("train_svc", "svc", "classification", {}), ("train_linear", "linear", "regression", {}),
    ("train_ridge", "ridge", "regression", {}), ("train_lasso", "lasso", "regression", {}),
    ("train_forest_regressor", "forest", "regression", {}), ("train_gbt_regressor", "gbt", "regression", {}),
):
    query(_name)(_train(_model, _task, **_params))


def _manual_split(spark, d, target: str, task: str, *names):
    df = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"), "l_orderkey", *names, "l_extendedprice",
        (F.col("l_quantity") * 1000 + F.col("l_discount") * 5000 > 26000).cast("int").alias("big"))
    drop = [c for c in ("l_orderkey", "l_extendedprice", "big") if c != target]
    train, test = df.where("l_orderkey % 5 <> 0").drop(*drop), df.where("l_orderkey % 5 = 0").drop(*drop)
    return models.prepare(train, test, target, ["row_key"], task=task)


def _gauss(c: str) -> str:
    return f"ln(v{c}) + power({c} - m{c}, 2) / v{c}"


@query("nb_confusion", f"""
WITH t AS (SELECT CASE WHEN l_quantity * 1000 + l_discount * 5000 > 26000 THEN 1.0 ELSE 0.0 END AS y, l_quantity AS a, l_discount AS b, l_tax AS c, l_orderkey % 5 = 0 AS test FROM lineitem),
m AS (SELECT y AS k, count(*) AS n, avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb, avg(c) AS mc, var_pop(c) AS vc FROM t WHERE NOT test GROUP BY y),
s AS (SELECT arg_max(k, ln(n) - 0.5 * ({_gauss('a')} + {_gauss('b')} + {_gauss('c')})) AS prediction, r, any_value(y) AS label FROM
 (SELECT *, row_number() OVER () AS r FROM t WHERE test) q, m GROUP BY r)
SELECT CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS cnt FROM s GROUP BY 1, 2""")
def nb_confusion(spark, d):
    data = _manual_split(spark, d, "big", "classification", "l_quantity", "l_discount", "l_tax")
    return evaluate.confusion_matrix(models.train_one("naive_bayes", data)[1])


@query("linear_test_metrics", """
WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem WHERE l_orderkey % 5 <> 0),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, m WHERE l_orderkey % 5 = 0)
SELECT count(*) AS n, round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(power(y - p, 2))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae FROM p""")
def linear_test_metrics(spark, d):
    data = _manual_split(spark, d, "l_extendedprice", "regression", "l_quantity")
    out = evaluate.regression_metrics(models.train_one("linear", data)[1]).drop("mse")
    return rounded(rounded(out, 6, "r2"), 3, "rmse", "mae")


def _penalised_sql(slope: str) -> str:
    return f"""
WITH m AS (SELECT count(*) AS n, avg(l_discount) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_discount) AS sxx,
 regr_sxy(l_extendedprice, l_discount) AS sxy FROM lineitem WHERE l_orderkey % 5 <> 0),
k AS (SELECT mx, my, {slope} AS b FROM m), p AS (SELECT l_discount AS x, my + b * (l_discount - mx) AS p FROM lineitem, k WHERE l_orderkey % 5 = 0)
SELECT count(*) AS n, round(avg(p), 1) AS mean, round(min(p), 1) AS low, round(max(p), 1) AS high FROM p"""


def _penalised(spark, d, name: str):
    data = _manual_split(spark, d, "l_extendedprice", "regression", "l_discount")
    scored = models.train_one(name, data)[1]
    return scored.agg(F.count("*").alias("n"), *[F.round(f("prediction"), 1).alias(a) for f, a in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))])


@query("ridge_predictions", _penalised_sql("sxy / (sxx + 1)"))
def ridge_predictions(spark, d):
    return _penalised(spark, d, "ridge")


@query("lasso_predictions", _penalised_sql("sign(sxy) * greatest(abs(sxy) / n - 1, 0) / (sxx / n)"))
def lasso_predictions(spark, d):
    return _penalised(spark, d, "lasso")


_FACTS = models.CLASSIFIERS


@query("training_facts", "WITH t AS (SELECT l_quantity * 1000 + l_discount * 5000 > 26000 AS big FROM lineitem WHERE l_orderkey % 5 = 0) "
       f"SELECT model, count(*) AS n, CAST(sum(CAST(big AS INT)) AS BIGINT) AS positives, true AS beats_majority FROM t, (VALUES {', '.join(f"('{m}')" for m in _FACTS)}) m(model) GROUP BY model")
def training_facts(spark, d):
    """Of every classifier: scored rows and positives, and that its errors are fewer than those of the larger class."""
    data = _manual_split(spark, d, "big", "classification", "l_quantity", "l_discount", "l_tax")
    found = None
    for name in _FACTS:
        scored = models.train_one(name, data)[1]
        one = scored.agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"), F.count_if(F.col("label") != F.col("prediction")).alias("wrong"))
        one = one.select(F.lit(name).alias("model"), "n", "positives", (F.col("wrong") < F.least("positives", F.col("n") - F.col("positives"))).alias("beats_majority"))
        found = one if found is None else found.unionByName(one)
    return found


_DEAR = "o_totalprice > 0.995 * (SELECT max(o_totalprice) FROM {orders})"


@query("flow_failure_log", f"""
WITH n AS (SELECT 'all' AS session, count(*) >= 10 AS usable FROM orders UNION ALL SELECT 'dear', count(*) >= 10 FROM orders WHERE {_DEAR.format(orders='orders')}),
s AS (SELECT * FROM (VALUES (0, 'ingestion'), (1, 'profiling'), (2, 'cleaning'), (3, 'selection'), (4, 'features')) t(place, phase))
SELECT session, phase, CASE WHEN place = 0 THEN usable ELSE place < 4 END AS success FROM n, s WHERE place = 0 OR usable""")
def flow_failure_log(spark, d):
    """Runs over all and over the dearest orders: too few are refused, else a user's step names no column and that stage fails."""
    logs = []
    for session, which in (("all", "true"), ("dear", _DEAR)):
        part = spark.sql(f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM {{orders}} WHERE {which}", orders=table(spark, d, "orders"))
        try:
            logs += flow.run_flow(part, "o_orderpriority", ["o_orderkey"], flow.Params(models=("naive_bayes",), hooks=["nothing / 2 AS half"]), session=session).log
        except flow.FlowFailed as failed:
            logs += failed.log
    return flow.run_log_frame(spark, logs).select("session", "phase", "success")


@query("train_weighted")
def train_weighted(spark, d):
    data = models.balanced(_prepared(spark, d, "big", "classification"))
    return models.leaderboard_frame(spark, models.train_models(data, ["naive_bayes"], weight="weight")).drop("seconds")


@query("feature_importance")
def feature_importance(spark, d):
    data = _prepared(spark, d, "big", "classification")
    found = models.train_models(data, ["forest"])[0].importances
    return evaluate.importance_share(spark.createDataFrame(list(found.items()), "feature string, importance double"))


@query("saved_model_scores")
def saved_model_scores(spark, d):
    from wideloom.plans.catalog_profile import _scratch
    data = _prepared(spark, d, "big", "classification")
    fitted, _ = models.train_one("logistic", data)
    path = models.save_model(fitted, _scratch(spark, "model"))
    return evaluate.binary_metrics(models.score(models.load_model(path), data.test))


@query("grid_search")
def grid_search(spark, d):
    data = _prepared(spark, d, "big", "classification")
    return tuning.grid_search("logistic", data)[1]


@query("vote_ensemble")
def vote_ensemble(spark, d):
    data = _prepared(spark, d, "big", "classification")
    scored = [models.train_one(n, data)[1] for n in ("logistic", "naive_bayes")]
    return evaluate.binary_metrics(tuning.vote(scored))


@query("stacked_ensemble")
def stacked_ensemble(spark, d):
    data = _prepared(spark, d, "big", "classification")
    return evaluate.binary_metrics(tuning.stack(["logistic", "naive_bayes"], data))


@query("orders_flow")
def orders_flow(spark, d):
    """All eight stages on orders: predict the status."""
    df = table(spark, d, "orders").withColumn("big", F.col("o_totalprice") > 300000)
    out = flow.run_flow(df, "o_orderstatus", ["o_orderkey"], flow.Params(models=("logistic", "naive_bayes")))
    return out.board.drop("seconds")


@query("orders_flow_log", "SELECT 'run' AS session, CAST(8 AS BIGINT) AS completed, 100.0 AS progress_pct FROM orders HAVING count(*) >= 50")
def orders_flow_log(spark, d):
    from wideloom.operators.runlog import progress
    df = table(spark, d, "orders")
    out = flow.run_flow(df, "o_orderstatus", ["o_orderkey"], flow.Params(models=("naive_bayes",), split_first=False))
    return progress(flow.run_log_frame(spark, out.log)).select("session", "completed", "progress_pct")


@query("encode_target_many", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_totalprice) - 1 AS DOUBLE) AS label FROM orders")
def encode_target_many(spark, d):
    """Index of a numeric target with more classes than the driver lists."""
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return models.encode_target(df, "o_totalprice")[0].select("o_orderkey", "label")

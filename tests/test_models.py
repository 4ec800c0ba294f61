import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wideloom.operators import evaluate, models, split, tuning
from wideloom.plans import catalog_models
from wideloom.plans.catalog import ORACLES
from wideloom.plans.flow import Params, Stages, run_flow, run_log_frame
from wideloom.operators.runlog import completion_summary


@pytest.fixture(scope="module")
def sales(spark):
    """The first 200 orders: is the price above what customer and month suggest?  Some nulls by order number."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").orderBy("o_orderkey").limit(200)
    price, month = F.col("o_totalprice"), F.month("o_orderdate").cast("double")
    return orders.select(
        F.col("o_orderkey").alias("order_no"), F.when(F.col("o_orderkey") % 37 != 0, price + F.col("o_orderkey") / 1000).alias("price"),
        F.when(F.col("o_orderkey") % 29 != 0, month).alias("month"), (F.col("o_custkey") % 40).cast("int").alias("account"), F.col("o_orderpriority").alias("priority"),
        (price + month * 9_000 + F.pmod(F.xxhash64("o_orderkey"), F.lit(60_000)) > 340_000).cast("int").alias("large"))


@pytest.fixture(scope="module")
def prepared(sales):
    train, test = split.train_test(sales.drop("priority"), ["order_no"], "large")
    return models.prepare(train, test, "large", ["order_no"])


def test_preparation(prepared, sales):
    assert prepared.task == "classification" and prepared.classes == ["0", "1"] and "order_no" not in prepared.features
    assert prepared.train.count() + prepared.test.count() == sales.count()
    assert prepared.train.join(prepared.test, "row_key").count() == 0


def test_target_order(spark):
    df = spark.createDataFrame([("B",), ("A",), (None,)], "y string")
    assert models.encode_target(df, "y")[1] == ["A", "B", "missing"]
    numbers = spark.createDataFrame([(10,), (2,), (None,)], "y int")
    assert models.encode_target(numbers, "y")[1] == ["2", "10", "missing"]


@pytest.mark.parametrize("range_rows", [10 ** 6, 7])
def test_label_encoding_of_many_values(spark, range_rows):
    from wideloom.operators.running import sorted_index
    df = spark.range(100).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    got = {r["k"]: r["i"] for r in sorted_index(df, "k", "i", range_rows).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    out = models.label_encode(spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "t string"), "t", "c")
    assert sorted(r["c"] for r in out.collect()) == [0, 1, 1, 2]


def test_class_weights_balance(prepared):
    train = models.balanced(prepared).train
    sums = [r["s"] for r in train.groupBy("label").agg(F.sum("weight").alias("s")).collect()]
    assert sums[0] == pytest.approx(sums[1])
    assert models.train_models(models.balanced(prepared), ["logistic"], weight="weight")[0].error == ""


@pytest.mark.parametrize("name,params", [("logistic", {}), ("forest", {"trees": 10}), ("gbt", {"maxIter": 5}), ("knn", {}), ("naive_bayes", {}), ("svc", {"maxIter": 10})])
def test_classifiers_beat_guessing(prepared, name, params):
    got = models.train_models(prepared, [name], **params)[0]
    assert got.error == "" and got.metrics["accuracy"] > 0.6
    assert set(got.importances) <= set(prepared.features)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_forests_tell_many_cells_apart(spark, task):
    """Every cell of a 16 x 16 board has a label of its own, more than the 32 leaves of depth 5 can tell."""
    df = spark.range(4096).select("id", (F.col("id") % 16 * 1.0).alias("a"), (F.floor(F.col("id") / 16) % 16 * 1.0).alias("b"))
    df = df.withColumn("y", F.pmod(F.xxhash64("a", "b"), F.lit(2)).cast("int"))
    data = models.prepare(*split.train_test(df, ["id"]), "y", ["id"], task=task)
    scored = models.train_one("forest", data, trees=20, features="all")[1]
    wrong = scored.where(F.abs(F.col("label") - F.col("prediction")) > 0.4).count()
    assert wrong < 0.1 * scored.count()
    assert tuning.GRIDS["forest"]["max_depth"] == [None, 10, 20]


def test_regressors_recover_a_line(spark):
    df = spark.range(300).select("id", (F.col("id") % 17 * 1.0).alias("a"), (F.col("id") % 23 * 1.0).alias("b"))
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 5)
    data = models.prepare(*split.train_test(df, ["id"]), "y", ["id"], task="regression")
    board = {t.name: t for t in models.train_models(data, ["linear", "ridge", "lasso"])}
    assert all(t.metrics["r2"] > 0.9 for t in board.values())
    assert board["linear"].importances["a"] == pytest.approx(3.0, abs=1e-6)
    assert board["linear"].metrics["r2"] >= board["ridge"].metrics["r2"] >= board["lasso"].metrics["r2"]


def test_ridge_penalty_matches_the_closed_form(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 2)) * [1.0, 5.0]
    y = x @ [1.5, -0.5] + rng.normal(size=80)
    df = spark.createDataFrame(pd.DataFrame({"id": range(80), "a": x[:, 0], "b": x[:, 1], "y": y}))
    data = models.prepare(df, df.limit(10), "y", ["id"], task="regression")
    fitted, _ = models.train_one("ridge", data)
    xc, yc = x - x.mean(0), y - y.mean()
    np.testing.assert_allclose(fitted.stages[-1].coefficients.toArray(), np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc), rtol=1e-6)


def test_failing_model_is_tolerated(prepared, spark):
    got = models.train_models(prepared, ["no_such_model", "naive_bayes"])
    assert got[0].error and not got[1].error
    board = models.leaderboard(models.leaderboard_frame(spark, got), "classification")
    assert models.best_model(board, "classification").head()["model"] == "naive_bayes"


def test_a_failure_is_no_result(prepared, spark, monkeypatch):
    """Where the only model fails, the query fails with it, instead of giving no rows; a failure without a text is one as well."""
    def fails(data, **_):
        raise MemoryError
    monkeypatch.setattr(models, "fit_forest", fails)
    with pytest.raises(RuntimeError, match="forest") as failed:
        catalog_models.feature_importance(spark, "/root/testdata/sf0.001")
    assert isinstance(failed.value.__cause__, MemoryError)
    assert [bool(t.error) for t in models.train_models(prepared, ["forest", "naive_bayes"])] == [True, False]


def test_primary_metric_order(spark):
    board = spark.createDataFrame([("a", 0.8, 0.75, 0.85, None, None), ("b", 0.9, 0.95, None, None, None), ("c", None, None, None, 0.7, 0.2)],
                                  "model string, accuracy double, f1 double, roc_auc double, r2 double, mae double")
    got = {r["model"]: r["m"] for r in board.select("model", models.primary_metric("classification").alias("m")).collect()}
    assert got == {"a": 0.85, "b": 0.95, "c": 0.0}
    assert models.best_model(board, "classification").head()["model"] == "a"
    assert models.best_model(board.drop("r2").withColumn("r2", F.lit(None).cast("double")), "regression").head()["model"] == "c"


def test_saved_model_scores_the_same(prepared, tmp_path):
    fitted, scored = models.train_one("naive_bayes", prepared)
    again = models.score(models.load_model(models.save_model(fitted, str(tmp_path / "m"))), prepared.test)
    assert again.exceptAll(scored).count() == 0


def test_grid_search_skips_small_tables(prepared):
    fitted, said = tuning.grid_search("logistic", prepared)
    assert fitted is None and "not tuned" in said.head()["config"]
    assert len(tuning.configurations("gbt")) == 27 and len(tuning.configurations("gbt", limit=25)) == 25 and tuning.configurations("naive_bayes") == [{}]


def test_ensembles(prepared):
    scored = [models.train_one(n, prepared)[1] for n in ("logistic", "naive_bayes")]
    voted = tuning.vote(scored)
    assert voted.count() == prepared.test.count()
    assert evaluate.roc_auc(tuning.stack(["logistic", "naive_bayes"], prepared, folds=2)).head()[0] > 0.7
    assert tuning.accept(0.8, 0.85) and not tuning.accept(0.8, 0.83)


@pytest.mark.parametrize("first", [True, False])
def test_whole_flow(sales, spark, tmp_path, first):
    stages = Stages(spark, str(tmp_path), "r")
    out = run_flow(sales, "large", ["order_no"], Params(models=("logistic", "naive_bayes"), split_first=first), stages=stages)
    assert out.best is not None and 0 <= out.best.metrics["accuracy"] <= 1
    # A float column with almost only distinct values counts as an identifier.
    assert "price" in {o.column for o in out.plan if o.reason == "identifier"} and "price" not in out.train.columns
    assert out.train.count() + out.test.count() == sales.count() and "order_no" not in out.train.columns
    assert stages.last_stage() == "features"
    done = completion_summary(run_log_frame(spark, out.log)).head()
    assert done["completed"] == 8 and done["finished"]
    assert all(df.count() >= 0 for df in out.report().values())


def test_flow_refuses_unusable_tables(sales):
    with pytest.raises(ValueError, match="min_rows") as failed:
        run_flow(sales.limit(3), "large", ["order_no"])
    assert [(r[1], r[2]) for r in failed.value.log] == [("ingestion", False)]


def test_flow_overrides(sales):
    p = Params(exclude=["priority"], methods=["variance"], exclude_features=["account"], max_new_ratio=0.1, skip_feature_types=["ratio"], models=("naive_bayes",))
    out = run_flow(sales, "large", ["order_no"], p)
    assert "priority" not in out.train.columns and "age" not in out.train.columns and not any("ratio" in c for c in out.train.columns)


def _said(spark, rows):
    return spark.createDataFrame(rows, "row_key string, label double, prediction double, score double, probabilities array<double>")


def test_vote_of_three_classes_and_of_numbers(spark):
    a = _said(spark, [("x", 2.0, 0.0, 0.3, [0.4, 0.3, 0.3]), ("y", 1.0, 1.0, 0.6, [0.2, 0.6, 0.2])])
    b = _said(spark, [("x", 2.0, 2.0, 0.1, [0.1, 0.1, 0.8]), ("y", 1.0, 0.0, 0.4, [0.5, 0.4, 0.1])])
    assert {r["row_key"]: r["prediction"] for r in tuning.vote([a, b]).collect()} == {"x": 2.0, "y": 1.0}
    n = [_said(spark, [("x", 6.0, v, v, None)]) for v in (5.2, 8.7)]
    assert tuning.vote(n, "regression").head()["prediction"] == pytest.approx(6.95)
    with pytest.raises(Exception, match="cannot vote"):
        tuning.vote([a, n[0]]).collect()


def test_features_without_limits(spark):
    from wideloom.operators.features import plan_features
    df = spark.createDataFrame([tuple(float(i * j + 1) for j in range(8)) for i in range(30)], ", ".join(f"c{j} double" for j in range(8)))
    every = plan_features(df, max_new_ratio=None, per_kind=None, partners=None, interactions=None)
    assert sum(o.op_type == "ratio" for o in every) == 28 and sum(o.op_type == "binning" for o in every) == 8


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_boosting_on_cells_is_boosting_on_rows(spark, monkeypatch, task):
    """Few bins: MLlib sees each cell once, and the trees are those of the rows; many cells: the rows themselves."""
    rows = spark.range(0, 4000, 1, 4).selectExpr(
        "CAST(id AS STRING) AS row_key", "CAST(xxhash64(id) % 7 AS DOUBLE) AS a", "CAST(xxhash64(id, 1) % 9 AS DOUBLE) / 4 AS b", "CAST(xxhash64(id, 2) % 5 AS DOUBLE) AS e")
    label = F.expr("CAST(a * b + e > 1 AS DOUBLE)" if task == "classification" else "a * b + e")
    part = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.withColumn("label", label)).cache()
    data = models.Prepared(part, part, task, ["a", "b"], ["0", "1"] if task == "classification" else [])
    counted = []
    cells = models.boosting_cells
    monkeypatch.setattr(models, "boosting_cells", lambda *args: counted.append(cells(*args)) or counted[-1])
    got = models.score(models.fit_boosted(data, 4000, maxIter=8), part)
    assert len(counted) == 1 and counted[0].count() <= 13 * 17 * 2
    assert counted[0].agg(F.sum("_weight")).head()[0] == 4000
    plain = models.score(models.estimator("gbt", task, 2, 4000, maxIter=8).fit(part), part)
    value = "score" if task == "classification" else "prediction"
    apart = got.select("row_key", F.col(value).alias("x")).join(plain.select("row_key", F.col(value).alias("y")), "row_key")
    assert apart.count() == 4000 and apart.agg(F.max(F.abs(F.col("x") - F.col("y")))).head()[0] < 1e-9
    models.fit_boosted(data, 300, maxIter=1)   # more cells than half of that many rows
    assert len(counted) == 1


def test_test_rows_are_scored_once(spark, prepared, monkeypatch):
    """All metrics of a model look at the same scores."""
    scored_rows = spark.sparkContext.accumulator(0)
    fit = models.train_one

    def counted(name, data, **params):
        fitted, scored = fit(name, data, **params)

        def count(batches):
            for batch in batches:
                scored_rows.add(batch.num_rows)
                yield batch
        return fitted, scored.mapInArrow(count, scored.schema)
    monkeypatch.setattr(models, "train_one", counted)
    done = models.train_models(prepared, ["naive_bayes"])[0]
    assert not done.error and "roc_auc" in done.metrics
    assert scored_rows.value == prepared.test.count()


def test_neighbours_of_equal_rows(spark):
    """Repeated features and repeated keys: every test row is scored once, as by looking at all pairs."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (500, 2)).astype(float)
    keys, y = [str(k) for k in rng.integers(0, 300, 500)], rng.integers(0, 2, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"row_key": keys, "label": y, "a": x[:, 0], "b": x[:, 1], "at": range(500)}))
    part = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.repartition(5))
    data = models.Prepared(part.where("at < 350 AND a <> 5"), part.where("at >= 350"), "classification", ["a", "b"], ["0", "1"])
    scored = models.train_one("knn", data)[1]
    assert scored.count() == 150
    train = [i for i in range(350) if x[i, 0] != 5]
    said = {}
    for q in range(350, 500):
        d = {i: ((x[i] - x[q]) ** 2).sum() for i in train}
        order = sorted(train, key=lambda i: (d[i], keys[i], *x[i]))
        near = order[:5]
        # Rows of one key at one distance may come in any order: only queries without such a tie at the border are told apart.
        if d[order[4]] != d[order[5]] or keys[order[4]] != keys[order[5]]:
            votes = y[near].sum()
            said[keys[q], tuple(x[q])] = float(votes > 2)
    found = {}
    for r in scored.join(data.test.select(F.col("row_key").alias("k"), "a", "b", F.col("label").alias("l")), (F.col("k") == F.col("row_key")) & (F.col("l") == F.col("label"))).collect():
        found.setdefault((r["row_key"], (r["a"], r["b"])), set()).add(r["prediction"])
    assert len(said) > 100 and all(v in found[k] for k, v in said.items())


def test_facts_and_bins_leave_nothing_out(spark):
    """Every classifier has its facts, and the bins know a value that one row of many has."""
    assert set(catalog_models._FACTS) == set(models.CLASSIFIERS)
    assert "('knn')" in ORACLES["training_facts"]
    rows = spark.range(0, 60_000, 1, 3).selectExpr("CAST(id % 9 AS DOUBLE) + CAST(id = 777 AS DOUBLE) / 2 AS a", "CAST(id AS DOUBLE) AS b")
    few, many = models.bin_values(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows))
    assert set(few) == {*range(9), 777 % 9 + 0.5} and len(many) == 32 and abs(many[15] - 60_000 * 15.5 / 32) < 20

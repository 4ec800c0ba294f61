"""The forest trainer against a plain recursive one, in both phases."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wideloom.operators import forest, models, split, tuning


def plain(x, y, w, classes, spec, seed, depth=0):
    """An exact tree as nested tuples: every border between two values of every tried feature is looked at."""
    sums = forest.sums_of(y, w, classes).sum(0)
    leaf = tuple(forest.outcome(sums, classes > 0))
    if len(y) < spec.min_split or y.min() == y.max() or depth == spec.max_depth:
        return leaf
    rank = {f: float(forest.mix(np.array([seed], np.uint64), f + 7)[0]) for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()}
    best = (-np.inf, None, None)
    for f in sorted(sorted(rank, key=rank.get)[:spec.tried(x.shape[1])]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            low = x[:, f] <= a
            if min(low.sum(), (~low).sum()) >= spec.min_leaf:
                score = sum(float(forest.quality(forest.sums_of(y[m], w[m], classes).sum(0), classes > 0)) for m in (low, ~low))
                if score > best[0]:
                    best = (score, f, a + (b - a) / 2)
    if best[1] is None:
        return leaf
    low, seeds = x[:, best[1]] <= best[2], forest.mix(np.array([seed] * 2, np.uint64), np.array([1, 2]))
    kids = [plain(x[m], y[m], w[m], classes, spec, int(s), depth + 1) for m, s in ((low, seeds[0]), (~low, seeds[1]))]
    return best[1], best[2], *kids


def nested(tree, size, i=0):
    if tree["feature"][i] < 0:
        return tuple(tree["value"].reshape(-1, size)[i])
    return int(tree["feature"][i]), float(tree["threshold"][i]), nested(tree, size, tree["left"][i]), nested(tree, size, tree["right"][i])


def test_grown_trees_equal_plain_ones():
    rng = np.random.default_rng(0)
    for case in range(60):
        n, d = rng.integers(1, 120), rng.integers(1, 6)
        x = rng.integers(0, rng.integers(2, 40), (n, d)).astype(float)
        classes = (0, 2, 3)[case % 3]
        y, w = rng.integers(0, classes or 50, n).astype(float), rng.integers(1, 4, n).astype(float)
        spec = forest.Spec(features=("sqrt", "all", 2)[case % 3], max_depth=(None, 3)[case % 2], min_split=(2, 5)[case % 2], min_leaf=(1, 1, 3)[case % 3])
        assert nested(forest.grow(x, y, w, classes, spec, 99), max(classes, 1)) == plain(x, y, w, classes, spec, 99), case


@pytest.mark.parametrize("classes", [0, 2])
def test_columns_are_sorted_once_per_tree(monkeypatch, classes):
    """Below the root, rows keep their order inside a kid and are not sorted again."""
    rng = np.random.default_rng(3)
    x, w = rng.integers(0, 300, (2000, 4)).astype(float), rng.integers(1, 4, 2000).astype(float)
    y = (x[:, 0] * 7 + x[:, 1] + rng.integers(0, 900, 2000)) // (1000 if classes else 1)
    y, sorted_, sort = np.minimum(y, classes - 1) if classes else y, [], np.argsort
    monkeypatch.setattr(forest.np, "argsort", lambda *a, **k: sorted_.append(1) or sort(*a, **k))
    tree = forest.grow(x, y, w, classes, forest.Spec(features="all"), 5)
    assert len(sorted_) == 4 and len(tree["feature"]) > 100
    spec = forest.Spec(features="all", max_depth=9)
    assert nested(forest.grow(x, y, w, classes, spec, 5), max(classes, 1)) == plain(x, y, w, classes, spec, 5)


def test_a_pass_hashes_keys_once(monkeypatch):
    """The hash of keys and seed is that of all trees: one for a buffer of rows, and one more for each tree."""
    class Rows:
        def mapInArrow(self, count, schema):
            x = pa.array([[float(i % 7), float(i % 5)] for i in range(300)], pa.list_(pa.float64()))
            batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([float(i % 2) for i in range(300)]), pa.array([1.0] * 300), x], ["k", "y", "w", "x"])
            self.made = pa.Table.from_batches(list(count(iter([batch]))))
            return self

        def groupBy(self, *_):
            return self
        applyInArrow = groupBy

        def collect(self):
            return []
    rows, hashed, hash_ = Rows(), [], forest.mix
    tops = [forest.Top(t + 1) for t in range(10)]
    monkeypatch.setattr(forest, "mix", lambda h, salt: hashed.append(len(h)) or hash_(h, salt))
    forest._split_level(rows, tops, [(t, 0) for t in range(10)], [np.arange(6.0), np.arange(4.0)], 2, 2, forest.Spec(trees=10, bins=8))
    assert hashed == [300] * 11
    for t, table_ in zip(rows.made["node"].to_pylist(), rows.made.to_pylist()):
        drawn = forest.weights(np.arange(300), t, 42)
        assert np.frombuffer(table_["table"]).reshape(9, 3)[:, 0].sum() == (drawn > 0).sum()
        assert (table_["low"], table_["high"], table_["least"], table_["most"]) == (0.0, 6.0 if table_["f"] == 0 else 4.0, 0.0, 1.0)


def table(spark, n=900, d=4, classes=2, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 60, (n, d)).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] + rng.integers(0, 30, n)) // 20 % classes if classes else x[:, 0] * 3 + x[:, 1] + rng.integers(0, 5, n)
    df = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)])
    df["id"], df["y"] = range(n), y.astype(int) if classes else y
    frame = spark.createDataFrame(df)
    return models.prepare(frame, frame, "y", ["id"], task="classification" if classes else "regression"), x, y


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_equals_plain_trees(spark, classes):
    data, x, y = table(spark, 200, classes=classes)
    model = models.fit_forest(data, trees=6)
    spec = model.spec
    keys = np.array([r["k"] for r in data.train.select(F.xxhash64("row_key").alias("k"), F.col("row_key").cast("int").alias("i")).orderBy("i").collect()])
    parts = {r["tree"]: r for r in model.parts.collect()}
    assert sorted(parts) == list(range(6))
    for t in range(6):
        w = forest.weights(keys, t, spec.seed)
        live = w > 0
        tree = {k: np.array(parts[t][k]) for k in ("feature", "threshold", "left", "right", "value")}
        assert nested(tree, max(classes, 1)) == plain(x[live], y[live].astype(float), w[live].astype(float), classes, spec, model.tops[t].seed[0])
    assert abs(forest.weights(np.arange(100_000), 3, 42).mean() - 1) < 0.02


@pytest.mark.parametrize("classes", [0, 2])
@pytest.mark.parametrize("bins", [3, 64])
def test_histogram_phase_and_pieces(spark, monkeypatch, classes, bins):
    """Many passes over all rows and several pieces: as good as the exact forest, and the same however rows are spread."""
    data, _, _ = table(spark, 900, classes=classes)
    exact = models.metrics_of(models.score(models.fit_forest(data, trees=10), data.test), data.task)
    model = models.fit_forest(data, trees=10, task_rows=60, bins=bins)
    assert max(len(top.feature) for top in model.tops) > 5 and model.parts.count() > 50
    whole = models.score(model, data.test)
    found = models.metrics_of(whole, data.task)
    name = "accuracy" if classes else "r2"
    assert found[name] > exact[name] - 0.05
    sizes = model.parts.select(F.sum(F.size("feature"))).head()[0]
    monkeypatch.setattr(forest, "PIECE_BYTES", sizes * 24 // 3)
    pieces = models.score(model, data.test)
    close = whole.alias("a").join(pieces.alias("b"), "row_key").where("abs(a.prediction - b.prediction) > 1e-9").count()
    assert close == 0
    spread = models.Prepared(data.train.repartition(13), data.test, data.task, data.features, data.classes)
    again = models.fit_forest(spread, trees=10, task_rows=60, bins=bins)
    assert [top.feature for top in again.tops] == [top.feature for top in model.tops]


def test_depth_constants_and_ties(spark):
    rows = [(i, 5.0, float(i % 2), i % 3) for i in range(60)] + [(100 + i, 5.0, 1.0, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    data = models.prepare(df, df, "y", ["id"], task="classification")
    for task_rows in (10_000, 20):
        scored = models.score(models.fit_forest(data, trees=3, task_rows=task_rows), data.test).collect()
        assert len(scored) == 560 and all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in scored)
    shallow = models.fit_forest(data, trees=2, max_depth=1)
    assert all(len(r["feature"]) <= 3 for r in shallow.parts.collect())
    with pytest.raises(ValueError, match="rows"):
        forest.fit(data.train.limit(0), 3, 2, forest.Spec())


def test_importances_weights_and_saved_forests(spark, tmp_path):
    data, _, _ = table(spark, 600)
    fitted, scored = models.train_one("forest", models.balanced(data), trees=8, weight="weight")
    shares = fitted.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares[1] > shares[2] and shares[0] > shares[3]
    again = models.score(models.load_model(models.save_model(fitted, str(tmp_path / "f")), "forest"), data.test)
    assert again.exceptAll(scored).count() == 0
    few = fitted.transform(data.test, trees=3).select("prediction").collect()
    assert len(few) == 600


def test_split_keeps_keys_apart(spark):
    """A held-out part is predicted well from features alone."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(1500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": (x[:, 0] * x[:, 1] > 0).astype(int)}))
    data = models.prepare(*split.train_test(df, ["id"]), "y", ["id"], task="classification")
    assert models.train_models(data, ["forest"], trees=30)[0].metrics["accuracy"] > 0.9


def test_grid_shares_fits_between_numbers_of_trees(spark, monkeypatch):
    data, _, _ = table(spark, 600)
    fits, fit = [], tuning.fit_forest
    monkeypatch.setattr(tuning, "fit_forest", lambda d, **kw: fits.append(kw) or fit(d, **kw))
    grid = {"trees": [2, 6], "max_depth": [None, 1], "min_split": [2, 40]}
    best, board = tuning.grid_search("forest", data, grid, folds=2)
    rows = board.collect()
    assert len(rows) == 8 and len(fits) == 2 * 4 + 1 and all(0.3 < r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == max(r["score"] for r in rows) and best.spec.trees in (2, 6)
    few, many = fit(data, trees=2), fit(data, trees=6)
    assert models.score(many, data.test, trees=2).exceptAll(models.score(few, data.test)).count() == 0
    assert len(tuning.configurations("forest")) == 27


@pytest.mark.parametrize("classes", [0, 3])
def test_a_large_forest_stays_out_of_the_driver(spark, monkeypatch, classes):
    """Rows to score go to the subtrees: nothing of a forest above PIECE_BYTES is collected, and the votes are the same to the last bit."""
    data, _, _ = table(spark, 700, classes=classes)
    model = models.fit_forest(data, trees=7, task_rows=80, bins=16)
    small = models.score(model, data.test).cache()
    assert small.count() == 700
    monkeypatch.setattr(forest, "PIECE_BYTES", 0)
    monkeypatch.setattr(model, "_add", None)
    large = models.score(model, data.test)
    assert large.exceptAll(small).count() == 0 and large.count() == 700
    assert models.score(model, data.test, trees=3).count() == 700


def test_equal_rows_are_one_row_of_a_tree(spark, monkeypatch):
    """A table with few different rows needs no pass by level, and gives the trees of the rows themselves."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, (3000, 3)).astype(float)
    y = (x.sum(1) + rng.integers(0, 2, 3000) > 6).astype(int)
    df = pd.DataFrame(x, columns=["f0", "f1", "f2"])
    df["id"], df["y"] = range(3000), y
    frame = spark.createDataFrame(df).repartition(3)
    data = models.prepare(frame, frame, "y", ["id"], task="classification")
    whole = models.fit_forest(data, trees=3)

    def levels(*_):
        raise AssertionError("a pass over the rows by level")
    monkeypatch.setattr(forest, "_grow_tops", levels)
    few = models.fit_forest(data, trees=3, task_rows=1500)
    trees = lambda model: [[list(r[c]) for c in ("feature", "threshold", "left", "right", "value", "importance")] for r in model.parts.orderBy("tree").collect()]
    assert trees(few) == trees(whole)
    with pytest.raises(AssertionError, match="by level"):   # counts of rows matter
        models.fit_forest(data, trees=3, task_rows=1500, min_leaf=4)

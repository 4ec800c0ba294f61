"""Regressions of a grid side by side against MLlib's, one at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from wideloom.operators import logistic, models, tuning


@pytest.fixture(scope="module")
def data(spark):
    """Columns of very different size, one constant, and a noisy class."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 3)) * [1.0, 2e4, 0.01] + [0.0, 7e4, 3.0]
    y = (x[:, 0] + (x[:, 1] - 7e4) / 2e4 + rng.normal(size=1200) > 0.3).astype(float)
    frame = spark.createDataFrame(pd.DataFrame({"row_key": [str(i) for i in range(1200)], "label": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "one": 1.0})).repartition(3, "row_key")
    part = VectorAssembler(inputCols=["a", "b", "c", "one"], outputCol="features").transform(frame).select("row_key", "label", "features").cache()
    return models.Prepared(part, part, "classification", ["a", "b", "c", "one"], ["0", "1"])


def test_folds_equal_single_fits(data):
    from pyspark.ml.functions import vector_to_array
    rows = data.train.select("label", (F.crc32("row_key") % 3).cast("int").alias("fold"), vector_to_array("features").alias("x"), "features").cache()
    penalties = [300.0, 0.5]
    found = logistic.fit_folds(rows.drop("features"), logistic.packed(rows.drop("features"), 4), 4, 3, penalties)
    for fold in range(3):
        train = rows.where(F.col("fold") != fold)
        for c, p in enumerate(penalties):
            one = LogisticRegression(regParam=p / train.count(), standardization=False, tol=1e-12, maxIter=500).fit(train)
            np.testing.assert_allclose(found[fold, c], [*one.coefficients.toArray(), one.intercept], rtol=2e-4, atol=1e-7)


def test_grid_search_fits_side_by_side(data, monkeypatch):
    """One fit by MLlib, that of the best penalty, and passes that do not grow with folds times penalties; scores of a cross-validation."""
    fits, passes, fit, sums = [], [], LogisticRegression._fit, logistic._sums
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    monkeypatch.setattr(logistic, "_sums", lambda *a: passes.append(1) or sums(*a))
    fitted, board = tuning.grid_search("logistic", data)
    rows = board.collect()
    assert len(fits) == 1 and len(passes) < 25 and len(rows) == 3
    model = models.estimator("logistic", "classification", 2, 1200)
    maps = [{model.regParam: v / 1200} for v in tuning.GRIDS["logistic"]["regParam"]]
    plain = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=5, seed=42).fit(data.train)
    np.testing.assert_allclose(fitted.avgMetrics, plain.avgMetrics, atol=5e-4)
    assert rows[0]["score"] == max(fitted.avgMetrics) and {r["config"] for r in rows} == {"regParam=10.0", "regParam=1.0", "regParam=0.1"}
    assert models.score(fitted.bestModel, data.test).count() == 1200

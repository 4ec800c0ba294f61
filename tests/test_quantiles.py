import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from wideloom.operators import quantiles
from wideloom.operators.quantiles import exact_quantiles, iqr_fences

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def narrow(df, names, probs=PROBS, **kw):
    return exact_quantiles(df, names, probs, bucket_rows=kw.pop("bucket_rows", 5), bins=kw.pop("bins", 4), **kw)


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 50 + [7.0], list(range(100)), [None, 1.0, None, 9.0],
    [0.0] * 400 + list(range(200)), [10.0 ** k for k in range(-12, 13)], [-1e300, 1e300, 0.0, 5.0, 6.0, 7.0],
    [-0.0, 0.0, 1e-320, 2e-320, 5.0], [1e308, -1e308] * 20 + [3.0],
])
def test_rounds_agree_with_numpy(spark, values):
    got = narrow(frame(spark, values), ["x"])["x"]
    want = np.quantile([v for v in values if v is not None], PROBS)
    assert got == pytest.approx(list(want), rel=1e-12)


@pytest.mark.parametrize("shape", ["spread", "tied", "steep", "infinite", "uniform"])
def test_two_scans_agree_with_numpy(spark, monkeypatch, shape):
    """Steps of an octave are enough; no histogram round is needed."""
    rng = np.random.default_rng(len(shape))
    x = {"spread": rng.normal(size=3000), "tied": rng.integers(0, 5, 3000).astype(float), "steep": np.exp(rng.normal(size=3000) * 9),
         "uniform": rng.random(3000) * 1e5 - 3e4, "infinite": np.concatenate([np.full(400, -math.inf), rng.normal(size=2000), np.full(600, math.inf)])}[shape]
    monkeypatch.setattr(quantiles, "_histogram", None)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x[::-1]})).repartition(7)
    got = exact_quantiles(df, ["x", "y"], PROBS, bucket_rows=400)
    for name, v in (("x", np.sort(x)), ("y", np.sort(-x))):
        places = [(2999 * p, v[math.floor(2999 * p)], v[math.ceil(2999 * p)]) for p in PROBS]
        assert got[name] == pytest.approx([a if a == b else a + (b - a) * (at - math.floor(at)) for at, a, b in places], rel=1e-12)


def test_infinities_sort_to_the_ends(spark):
    got = narrow(frame(spark, [math.inf, -math.inf, *range(9)]), ["x"], [0.0, 0.5, 1.0])["x"]
    assert got == [-math.inf, 4.0, math.inf]


def test_nan_is_missing(spark):
    assert narrow(frame(spark, [math.nan, 1.0, 3.0]), ["x"], [0.5])["x"] == [2.0]


def test_several_columns_and_all_null(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": range(60), "b c": [v % 3 for v in range(60)]})).selectExpr("*", "cast(null as double) AS `n.x`")
    for rows in (4, 10 ** 6):
        got = exact_quantiles(df, ["a", "b c", "n.x"], [0.25, 0.5], bucket_rows=rows, bins=5)
        assert got == {"a": [14.75, 29.5], "b c": [0.0, 1.0], "n.x": [None, None]}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_any_floats(spark, values):
    got = narrow(frame(spark, values), ["x"], [0.25, 0.5, 0.9])["x"]
    assert got == pytest.approx(list(np.quantile(np.array(values, dtype="float64"), [0.25, 0.5, 0.9])), rel=1e-9, abs=1e-30)


def test_no_columns_no_rows(spark):
    assert exact_quantiles(frame(spark, [1]), [], [0.5]) == {}
    assert exact_quantiles(frame(spark, []), ["x"], [0.5]) == {"x": [None]}


def test_fences():
    assert iqr_fences((1.0, 3.0)) == (-2.0, 6.0)
    assert iqr_fences((None, None)) == (None, None)

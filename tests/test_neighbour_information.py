"""Mutual information by neighbours against a brute-force estimate."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wideloom.operators.neighbour_information import digamma, neighbour_information


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def plain(x, y, k):
    size = Counter(y)
    rows = [i for i in range(len(x)) if size[y[i]] > 1]
    total = 0.0
    for i in rows:
        same = sorted(abs(x[j] - x[i]) for j in rows if j != i and y[j] == y[i])
        used = min(k, len(same))
        far = same[used - 1]
        if far == 0:
            used = same.count(0)
        m = sum(abs(x[j] - x[i]) < far if far else x[j] == x[i] for j in rows)
        total += psi(used) - psi(size[y[i]]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows)) if rows else None


def test_digamma(spark):
    got = spark.range(1, 60).select("id", digamma(F.col("id")).alias("d")).collect()
    assert all(r["d"] == pytest.approx(psi(r["id"]), abs=1e-9) for r in got)


@pytest.mark.parametrize("range_rows", [10 ** 6, 40, 7])
def test_equals_brute_force(spark, range_rows):
    rng = np.random.default_rng(3)
    n = 300
    y = [("a", "b", "c")[v] for v in rng.integers(0, 3, n)]
    y[0], y[1], y[2] = "alone", "pair", "pair"
    shift = np.array([{"a": 0, "b": 1, "c": 4}.get(v, 2) for v in y])
    df = pd.DataFrame({"y": y, "near": rng.integers(-64, 64, n) / 64 + shift, "noise": rng.integers(0, 2 ** 20, n) / 2 ** 10,
                       "few": rng.integers(0, 4, n).astype(float) + (shift > 2), "fixed": 1.0})
    df["gaps"] = np.where(rng.random(n) < 0.3, 0.0, df["near"])
    names = ["near", "noise", "few", "fixed", "gaps"]
    given = spark.createDataFrame(df).withColumn("gaps", F.when(F.col("gaps") != 0, F.col("gaps")))
    found = {r["column"]: r["mi"] for r in neighbour_information(given, "y", names, range_rows=range_rows).collect()}
    assert found == pytest.approx({c: plain(df[c].tolist(), y, 3) for c in names}, abs=1e-6)
    assert found["near"] > 0.5 > found["noise"] and found["fixed"] == 0


def test_a_third_of_all_rows_shares_a_value(spark):
    df = spark.range(900).select((F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7)).alias("x"), F.when(F.col("id") < 450, "u").alias("y"))
    rows = df.collect()
    found = neighbour_information(df, "y", ["x"], range_rows=50).head()
    assert found["mi"] == pytest.approx(plain([r["x"] for r in rows], [r["y"] or "missing" for r in rows], 3), abs=1e-6)
    assert math.isfinite(found["mi"])


def test_no_rows(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, y string")
    assert neighbour_information(df, "y", ["x"]).collect() == []
    assert neighbour_information(df.limit(0), "y", ["x"]).collect() == []

import datetime as dt
import decimal
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from wideloom.functions.columns import families, normalise
from wideloom.functions.numbers import first_digits, to_number
from wideloom.operators import cleaning, counts, encoding, evaluate, features, profile, quality, relations, running, scaling, selection, split
from wideloom.operators.cleaning import CleaningOp
from wideloom.operators.features import FeatureOp


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, NaN, infinities, constants, odd names and every type family."""
    schema = T.StructType([
        T.StructField("a.b", T.DoubleType()), T.StructField("with space", T.IntegerType()), T.StructField("const", T.DoubleType()),
        T.StructField("void", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("flag", T.BooleanType()),
        T.StructField("day", T.DateType()), T.StructField("money", T.DecimalType(10, 2)), T.StructField("list", T.ArrayType(T.IntegerType()))])
    d = dt.date(2024, 1, 1)
    data = [(float(i) if i else math.nan, i % 3, 7.0, None, "x" if i % 2 else None, i % 2 == 0, d + dt.timedelta(i), decimal.Decimal(i), [i])
            for i in range(12)]
    return spark.createDataFrame(data, schema)


# Profile ---------------------------------------------------------------------------------------

def test_families(edge):
    f = families(edge)
    assert f.numeric == ("a.b", "with space", "const", "void", "money")
    assert (f.categorical, f.datetime, f.boolean, f.skipped) == (("text",), ("day",), ("flag",), ("list",))


def test_profile_of_edge_columns(edge):
    got = {(r["column"], r["stat"]): r["value"] for r in profile.profile_numeric(edge).collect()}
    assert got["a.b", "count"] == 11 and got["a.b", "median"] == 6.0
    assert got["const", "std"] == 0.0 and ("const", "skewness") not in got and got["const", "outliers"] == 0
    assert [k for k in got if k[0] == "void"] == [("void", "count")]
    want = pd.Series(range(1, 12), dtype="float64")
    for stat, value in (("mean", want.mean()), ("std", want.std()), ("skewness", want.skew()), ("kurtosis", want.kurt())):
        assert got["a.b", stat] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 2.0], [1.0, 2.0, 4.0]])
def test_profile_of_tiny_tables(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["stat"]: r["value"] for r in profile.profile_numeric(df).collect()}
    s = pd.Series(values, dtype="float64")
    if values:
        assert got["mean"] == pytest.approx(s.mean())
        assert ("std" in got) == (len(values) > 1) and ("skewness" in got) == (len(values) > 2)
    else:
        assert got == {}


def test_profile_is_stable_for_large_offsets(spark):
    values = 1e9 + np.random.default_rng(1).normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = {r["stat"]: r["value"] for r in profile.profile_numeric(df).collect()}
    s = pd.Series(values)
    assert got["std"] == pytest.approx(s.std(), rel=1e-6) and got["kurtosis"] == pytest.approx(pd.Series(values - 1e9).kurt(), rel=1e-4)


def test_nulls_and_flags(edge):
    nulls = {r["column"]: r["null_count"] for r in profile.null_profile(edge).collect()}
    assert (nulls["a.b"], nulls["void"], nulls["text"], nulls["list"]) == (1, 12, 6, 0)
    flags = {r["column"]: r for r in profile.distinct_flags(edge.drop("list")).collect()}
    assert flags["const"]["is_constant"] and flags["void"]["is_constant"] and flags["void"]["is_high_null"]
    assert flags["day"]["is_identifier"] and not flags["text"]["is_identifier"]


def test_text_profile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert profile.categorical_profile(df).count() == 0 and profile.top_values(df).count() == 0


def test_entropy_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "t string")
    r = profile.categorical_profile(df).head()
    p = np.array([0.4, 0.4, 0.2])
    assert (r["top"], r["freq"], r["unique_values"]) == ("a", 2, 3)
    assert r["entropy"] == pytest.approx(-(p * np.log2(p + 1e-10)).sum())


def test_approximate_profile_is_close(spark):
    df = spark.range(5000).select((F.col("id") * 1.0).alias("x"))
    got = {r["stat"]: r["value"] for r in profile.profile_numeric(df, approx=True).collect()}
    assert got["median"] == pytest.approx(2499.5, rel=0.01) and got["mean"] == pytest.approx(2499.5)


def test_duplicates_match_full_grouping(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a"), (2, "a"), (2, "a")], "k int, v string")
    assert counts.duplicate_rows(df).head()[0] == counts.duplicate_rows(df, repeated_hashes=0).head()[0] == 3
    assert counts.duplicate_rows(df.limit(0)).head()[0] == 0
    zero = spark.createDataFrame([(0.0,), (-0.0,), (math.nan,), (math.nan,)], "x double")
    assert counts.duplicate_rows(zero).head()[0] == 2


def test_modes_keep_types_and_break_ties(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (None, None)], "n int, t string")
    assert counts.modes(df, ["n", "t"]) == {"n": 1, "t": "a"}


@pytest.mark.parametrize("bound", [0, 10 ** 9])
def test_lookup_with_a_hot_key(spark, bound):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None)
                                  .otherwise(F.concat(F.lit("k"), F.col("id") % 2500)).alias("key"), "id")
    table = df.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).withColumn("code", F.col("n") * 10)
    got = counts.lookup(df, "key", table, "n", F.lit(-1), "code", broadcast_bytes=bound)
    assert got.columns == ["key", "id", "code"] and got.count() == 6000
    assert {tuple(r) for r in got.where("key = 'hot' OR key IS NULL").select("key", "code").distinct().collect()} == {("hot", 20000), (None, -1)}
    plain = df.join(table.select("key", "code"), "key", "left").fillna(-1, ["code"]).select("key", "id", "code")
    assert got.exceptAll(plain).count() == 0


# Relations -------------------------------------------------------------------------------------

def test_correlation_paths_agree_with_pandas(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 5)) + 1e6, columns=list("abcde"))
    pdf["e"] = pdf["a"] * 2 + rng.normal(size=300) * 0.01
    pdf.loc[::7, "b"] = np.nan
    pdf["k"] = 3.0
    df = spark.createDataFrame(pdf)
    want = pdf.corr()
    for limit in (10 ** 6, 0):
        monkeypatch.setattr(relations, "MAX_SUMS", limit)
        got = {(r["a"], r["b"]): r["r"] for r in relations.pairwise_r(df, list(itertools.combinations("abcdek", 2))).collect()}
        assert len(got) == 15
        for (a, b), r in got.items():
            assert r is None if "k" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-7)


def test_mutual_information_of_a_copy_is_its_entropy(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("y"), (F.col("id") % 3).alias("x"), (F.col("id") % 7 * 1.0).alias("z"))
    got = {r["column"]: r["mi_binned"] for r in relations.mutual_information(df, "y").collect()}
    assert got["x"] == pytest.approx(math.log(3)) and got["z"] < 0.02


@pytest.mark.parametrize("n,task", [(19, "classification"), (20, "regression")])
def test_task_boundary(spark, n, task):
    df = spark.range(100).select((F.col("id") % n).alias("y"))
    assert relations.is_classification(df, "y") == (task == "classification")
    assert relations.is_classification(df, "y", task="regression") is False


# Cleaning --------------------------------------------------------------------------------------

def test_number_parsing(spark):
    df = spark.createDataFrame([(v,) for v in ("1e3", " 12 ", "$1,234", "n/a", "nan", "1d", "2.5f", "-inf", ".5", "True", "", None)], "t string")
    got = [r[0] for r in df.select(to_number(F.col("t"))).collect()]
    assert got == [1000.0, 12.0, None, None, None, None, None, -math.inf, 0.5, None, None, None]
    assert cleaning.numeric_text_share(df.where("t LIKE '$%'"), ["t"]) == {"t": 1.0}
    digits = spark.createDataFrame([("ab12c3",), ("x",), (None,)], "t string")
    assert [r[0] for r in digits.select(first_digits(F.col("t"))).collect()] == [12, 0, 0]


def test_plan_follows_rule_order(spark):
    data = [(1, float(i % 4) if i % 5 else None, "k" if i % 3 else None, str(i % 6), f"id{i}", None if i < 19 else 1.0) for i in range(20)]
    df = spark.createDataFrame(data, "const int, num double, cat string, digits string, id string, nearly double")
    got = [(o.op_type, o.column) for o in cleaning.plan_cleaning(df)]
    assert got == [("remove_column", "const"), ("remove_column", "cat"), ("remove_column", "nearly"), ("remove_column", "nearly"),
                   ("remove_column", "id"), ("impute_numeric", "num"), ("convert_type", "digits")]
    assert all(o.column != "const" for o in cleaning.plan_cleaning(df, "const"))


def test_cleaning_invariants(edge, spark):
    df = edge.drop("list")
    plan = cleaning.plan_cleaning(df)
    done = cleaning.apply_cleaning(df, plan)
    after = {r["column"]: r["null_count"] for r in profile.null_profile(done.data).collect()}
    before = {r["column"]: r["null_count"] for r in profile.null_profile(df).collect()}
    assert all(after[c] <= before[c] for c in after)
    again = cleaning.apply_cleaning(df, cleaning.plan_from_frame(cleaning.plan_frame(df, done.applied)))
    assert again.data.exceptAll(done.data).count() == 0


def test_facts_spare_the_fits_and_change_nothing(edge, spark, monkeypatch):
    df = edge.drop("list")
    facts = profile.table_facts(df)
    plan = [o for o in cleaning.plan_cleaning(df, facts=facts) if o.op_type != "remove_duplicates"]
    assert "impute_numeric" in {o.op_type for o in plan}
    plain = cleaning.apply_cleaning(df, plan)
    spared = cleaning.apply_cleaning(df, plan, facts=facts)
    assert spared.applied == plain.applied and spared.nulls_filled == plain.nulls_filled
    assert spared.data.exceptAll(plain.data).count() == 0
    scans = []
    monkeypatch.setattr(cleaning, "exact_quantiles", lambda df, names, probs: scans.append(list(names)) or {})
    cleaning.apply_cleaning(df, [o for o in plan if o.op_type == "impute_numeric"], facts=facts)
    assert scans == [[]]


def test_imputation_comes_before_copies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (1.0, None)], "x double, t string")
    ops = [CleaningOp("impute_numeric", "x", {"strategy": "median"}), CleaningOp("impute_categorical", "t"), CleaningOp("remove_duplicates", "all")]
    done = cleaning.apply_cleaning(df, ops)
    assert [tuple(r) for r in done.data.collect()] == [(1.0, "a")] and done.nulls_filled == 2


def test_row_keys_do_not_hide_copies(spark):
    df = spark.createDataFrame([("k2", 1), ("k1", 1), ("k3", 2)], "row_key string, v int")
    done = cleaning.apply_cleaning(df, [CleaningOp("remove_duplicates", "all")], keep=["row_key"])
    assert rows(done.data, "row_key", "v") == [("k1", 1), ("k3", 2)]


def test_clip_keeps_nulls_and_bad_ops_are_reported(spark):
    df = spark.createDataFrame([(float(v), "t") for v in [1, 2, 3, 4, 100]] + [(None, "t")], "x double, t string")
    done = cleaning.apply_cleaning(df, [CleaningOp("handle_outliers", "x", {"method": "clip"}), CleaningOp("impute_numeric", "t"), CleaningOp("impute_numeric", "gone")])
    assert [r["x"] for r in done.data.collect()] == [1, 2, 3, 4, 7.0, None]
    assert [(o.op_type, o.column) for o in done.failed] == [("impute_numeric", "t")]


def test_all_null_column_cannot_be_imputed(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert len(cleaning.apply_cleaning(df, [CleaningOp("impute_numeric", "x")]).failed) == 1


# Selection -------------------------------------------------------------------------------------

def test_near_constant_column_is_removed(spark):
    df = spark.range(100).select(F.when(F.col("id") == 0, 2).otherwise(1).alias("low"), F.col("id").alias("good"), (F.col("id") % 2).alias("target"))
    v = {r["feature"]: r["variance"] for r in selection.variances(df).collect()}
    assert v["low"] == pytest.approx(0.0099)
    got = selection.select_features(df, "target")
    assert "low" in got.removed and got.reasons["low"] == "low variance" and set(got.kept) | set(got.removed) == {"low", "good"}


def test_selection_without_target(spark):
    df = spark.createDataFrame([(i, 2 * i, 1) for i in range(1, 6)], "f1 int, f2 int, f3 int")
    got = selection.select_features(df)
    assert got.kept == ["f1", "f2"] and got.removed == ["f3"]


def test_include_and_exclude(spark):
    df = spark.createDataFrame([(i, 2 * i, 1) for i in range(1, 6)], "f1 int, f2 int, f3 int")
    got = selection.select_features(df, include=["f3"], exclude=["f1"])
    assert got.kept == ["f2", "f3"] and got.removed == ["f1"]


def test_percentile_ties_fill_in_order():
    assert selection.keep_percentile([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]) == [False] * 3 + [True] * 7
    assert selection.keep_percentile([1.0, 1.0, 1.0]) == [True, True, False]
    assert selection.keep_percentile([None, 5.0]) == [False, True]


def test_correlation_drops():
    pairs = [("a", "b", 0.99), ("a", "c", 0.97), ("b", "c", 0.1)]
    assert selection.correlation_drops(pairs, ["a", "b", "c"], {"a": 0.5, "b": 0.4, "c": 0.6}) == ["b"]
    assert selection.correlation_drops(pairs, ["a", "b", "c"], None) == ["b"]
    assert selection.correlation_drops(pairs[:1], ["a", "b"], None) == []


# Encoding and features -------------------------------------------------------------------------

def test_category_count_boundaries(spark):
    df = spark.range(110).select(*[F.concat(F.lit("v"), F.col("id") % n).alias(f"c{n}") for n in (1, 2, 3, 10, 11)],
                                 F.when(F.col("id") % 2 == 0, "x").alias("holes"))
    kinds = {e.column: e.kind for e in encoding.fit_encoders(df)}
    assert kinds == {"c1": "constant", "c2": "binary", "c3": "label", "c10": "label", "c11": "frequency", "holes": "binary"}
    out = encoding.encode_table(df)
    assert out.columns == df.columns and rows(out.select("c11").distinct(), "c11") == [(10,)]
    assert rows(out.select("holes").distinct(), "holes") == [(0,), (1,)]


def test_encoders_replay_on_new_values(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    new = spark.createDataFrame([("c",), ("zzz",), (None,)], "t string")
    fitted = encoding.fit_encoders(train)
    assert [r[0] for r in encoding.apply_encoders(new, fitted, train).collect()] == [2, 0, 0]


def test_dates_booleans_and_arrays(edge):
    out = encoding.encode_table(edge.select("day", "flag", "list"))
    assert out.columns == ["day", "flag"] and rows(out.limit(1), "day", "flag") == [(2024, 1)]


def test_ratio_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, None), (math.inf, 1.0), (0.0, 0.0)], "a double, b double")
    out, done = features.apply_features(df, [FeatureOp("ratio", "r", ("a", "b"))])
    assert [r["r"] for r in out.collect()] == [1e8, 0.0, 3.0, 0.0, 0.0] and done[0].success


def test_bins_match_pandas(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=200), np.array([1.0, 1.0, 1.0]), np.array([1.0, 2.0, 3.0]), np.array([1.0, np.nan, 2.0])):
        df = spark.createDataFrame(pd.DataFrame({"x": values}))
        df = normalise(df)
        got = [r["b"] for r in features.apply_features(df, [FeatureOp("binning", "b", ("x",))])[0].collect()]
        distinct = len(set(values[~np.isnan(values)]))
        want = pd.cut(pd.Series(values), bins=5 if distinct >= 5 else max(2, distinct), labels=False, duplicates="drop").fillna(-1).astype(int)
        assert got == list(want)


def test_log_rows_and_row_aggregates(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (None, None), (3.0, None)], "a double, b double")
    out, _ = features.apply_features(df, [FeatureOp("log_transform", "l", ("a",))] + [
        FeatureOp("aggregation", how, ("a", "b"), {"operation": how}) for how in ("sum", "mean", "std")])
    got = [tuple(r)[2:] for r in out.collect()]
    assert got[0] == (0.0, 1.0, 0.5, pytest.approx(np.std([-1, 2], ddof=1)))
    assert got[1] == (None, 0.0, None, 0.0) and got[2][1:] == (3.0, 3.0, 0.0)


def test_feature_cap_and_skips(spark):
    df = spark.createDataFrame([tuple(float(i + j) for j in range(6)) for i in range(5)], ", ".join(f"f{j} double" for j in range(6)))
    ops = features.plan_features(df)
    assert len(ops) == 5 and {o.op_type for o in ops} == {"ratio"}
    assert len(features.skip_features(ops, ["ratio: f0_to_f1_ratio"])) == 4 and features.skip_features(ops, types=["ratio"]) == []


def test_features_never_remove_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a b")], "`x y` double, z double, t string")
    out, done = features.apply_features(df, features.plan_features(df, max_new_ratio=9.0), ["z + 1 AS z1"])
    assert set(df.columns) <= set(out.columns) and "z1" in out.columns and all(o.success for o in done)


def test_frequency_uses_the_fitted_table(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    out, _ = features.apply_features(spark.createDataFrame([("a",), ("q",)], "t string"), [FeatureOp("frequency_encoding", "f", ("t",))], fitted_on=train)
    assert rows(out, "t", "f") == [("a", 0.5), ("q", 0.0)]


def test_zscore_of_constant(spark):
    out = scaling.zscore(spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double"), ["x"])
    assert [r["x_z"] for r in out.collect()] == [0.0, 0.0, None]


def test_leakage_by_auc(spark):
    df = spark.range(200).select((F.col("id") >= 190).cast("int").alias("y"), F.col("id").alias("tell"), (F.col("id") % 7).alias("noise"))
    assert rows(scaling.leakage_risk(df, "y"), "column") == [("tell",)]


@pytest.mark.parametrize("range_rows", [500_000, 7])
def test_areas_of_many_columns(spark, monkeypatch, range_rows):
    """Equal to one run per column, with groups that span several ranges, nulls, ties and a column without values."""
    monkeypatch.setattr(evaluate, "running_totals_by", lambda *a, **k: running.running_totals_by(*a, **k, range_rows=range_rows))
    df = spark.range(300).select((F.hash("id") % 2 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("a"), (F.col("id") % 3).alias("b"),
                                 F.when(F.col("id") % 5 > 0, -F.col("id") / 7).alias("c"), F.lit(4).alias("d"), F.lit(None).cast("double").alias("e"))
    names = ["a", "b", "c", "d", "e"]
    got = {r[0]: r[1] for r in evaluate.roc_auc_many(df, "y", names).collect()}
    assert set(got) == set("abcd")
    for n in "abcd":
        assert got[n] == pytest.approx(brute_auc([(r[0], r[1]) for r in df.select("y", n).collect() if r[1] is not None]))
    assert evaluate.roc_auc_many(df.limit(0), "y", names).collect() == []


# Evaluation ------------------------------------------------------------------------------------

def test_known_binary_and_regression_values(spark):
    df = spark.createDataFrame([(0, 0, .2), (1, 1, .7), (0, 1, .6), (1, 1, .8), (0, 0, .1)], "label int, prediction int, score double")
    m = evaluate.binary_metrics(df).head()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.8, pytest.approx(2 / 3), 1.0, pytest.approx(0.8))
    assert evaluate.roc_auc(df).head()[0] == 1.0
    reg = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 2.9), (4.0, 3.9), (5.0, 5.1)], "label double, prediction double")
    r = evaluate.regression_metrics(reg).head()
    assert (r["mae"], r["mse"], r["rmse"], r["r2"]) == tuple(pytest.approx(v) for v in (0.1, 0.01, 0.1, 0.995))


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0, .5), (0, 0, .5)], "label int, prediction int, score double")
    m = evaluate.binary_metrics(df).head()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0) and evaluate.roc_auc(df).head()[0] is None


def brute_auc(pairs):
    pos, neg = ([s for y, s in pairs if y == v] for v in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("hot", [0, 150])
def test_ranges_give_the_same_curves(spark, monkeypatch, hot):
    rng = np.random.default_rng(hot)
    pairs = [(int(rng.random() < 0.4), float(rng.integers(0, 60)) / 60) for _ in range(300)] + [(i % 2, 0.5) for i in range(hot)]
    df = spark.createDataFrame(pairs, "label int, score double")
    one = (evaluate.roc_auc(df).head()[0], rows(evaluate.roc_curve(df), "threshold", "fpr", "tpr"), evaluate.curve_areas(df).head())
    monkeypatch.setattr(evaluate, "running_totals_by", lambda *a, **k: running.running_totals_by(*a, **k, range_rows=20))
    many = (evaluate.roc_auc(df).head()[0], rows(evaluate.roc_curve(df), "threshold", "fpr", "tpr"), evaluate.curve_areas(df).head())
    assert one[0] == pytest.approx(brute_auc(pairs)) and many[0] == pytest.approx(one[0]) and many[1] == one[1]
    assert tuple(many[2]) == pytest.approx(tuple(one[2])) and one[2]["roc_area"] == pytest.approx(one[0])


def test_report_has_classes_seen_on_one_side_only(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    got = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert got["b"]["support"] == 0 and got["c"]["recall"] == 0 and got["accuracy"]["f1"] == pytest.approx(1 / 3)


def test_stability_needs_more_than_ten_rows(spark):
    df = spark.range(10).select((F.col("id") * 1.0).alias("prediction"))
    assert evaluate.prediction_stability(df).count() == 0
    assert evaluate.prediction_stability(df.unionAll(df)).count() == 1


# Split -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("cell_rows", [10 ** 6, 5])
def test_split_is_exact_per_class(spark, cell_rows):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 20, None).otherwise(F.concat(F.lit("c"), F.col("id") % 2)).alias("y"))
    marked = split.with_split(df, ["id"], "y", cell_rows=cell_rows)
    sizes = {r["y"]: (r["n"], r["t"]) for r in marked.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == math.floor(n * 0.2 + 0.5) for n, t in sizes.values()) and sum(n for n, _ in sizes.values()) == 1000
    other = split.with_split(df.repartition(7), ["id"], "y", cell_rows=10 ** 6, broadcast_bytes=0)
    assert marked.exceptAll(other).count() == 0


def test_split_without_target_or_test_rows(spark):
    df = spark.range(50)
    train, test = split.train_test(df, ["id"], cell_rows=4)
    assert (train.count(), test.count(), train.intersect(test).count()) == (40, 10, 0)
    assert split.with_split(df, ["id"], test_share=0.0).where("is_test").count() == 0


# Quality ---------------------------------------------------------------------------------------

def test_validation_of_bad_tables(spark):
    tiny = spark.createDataFrame([(1, None)], "a int, y int")
    got = {r["check"]: r["passed"] for r in quality.ingest_validation(tiny, "y").collect()}
    assert got == {"min_rows": False, "min_columns": True, "empty_columns": False, "overall_nulls": True,
                   "target_present": True, "target_has_values": False, "target_null_share": False}
    assert {r["check"]: r["passed"] for r in quality.ingest_validation(tiny, "no").collect()}["target_present"] is False
    assert {r["stage"]: r["ready"] for r in quality.stage_preconditions(tiny, "y").collect()}["modeling"] is False
    empty = quality.ingest_validation(tiny.limit(0), "y").collect()
    assert not {r["check"]: r["passed"] for r in empty}["min_rows"]

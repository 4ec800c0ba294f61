"""Queries: cleaning, feature selection, encoding and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideloom.operators import cleaning, encoding, features, profile, scaling, selection
from wideloom.operators.cleaning import CleaningOp
from wideloom.operators.features import FeatureOp
from wideloom.plans.inputs import COPIES, DIRTY, RELATED, SELECTABLE
from wideloom.plans.registry import query, rounded, table, union_sql

# Cleaning --------------------------------------------------------------------------------------

KEYS = "l_orderkey, l_linenumber"


def _clean(df, *ops, **kw):
    return cleaning.apply_cleaning(df, list(ops), **kw).data


@query("clean_impute_median", f"WITH v AS ({DIRTY.sql}) SELECT {KEYS}, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM v)) AS qty, "
       "round(coalesce(sparse, (SELECT quantile_cont(sparse, 0.5) FROM v)), 6) AS sparse FROM v")
def clean_impute_median(spark, d):
    df = DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", "qty", "sparse")
    ops = [CleaningOp("impute_numeric", c, {"strategy": "median"}) for c in ("qty", "sparse")]
    return rounded(_clean(df, *ops), 6, "sparse")


@query("clean_impute_mean", f"WITH v AS ({DIRTY.sql}) SELECT {KEYS}, round(coalesce(qty, (SELECT avg(qty) FROM v)), 6) AS qty, "
       "coalesce(sparse, 0) AS sparse FROM v")
def clean_impute_mean(spark, d):
    df = DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", "qty", "sparse")
    return rounded(_clean(df, CleaningOp("impute_numeric", "qty", {"strategy": "mean"}),
                          CleaningOp("impute_numeric", "sparse", {"strategy": "zero"})), 6, "qty")


@query("clean_impute_mode", f"WITH v AS ({DIRTY.sql}) SELECT {KEYS}, coalesce(flag, (SELECT flag FROM v WHERE flag IS NOT NULL "
       "GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM v")
def clean_impute_mode(spark, d):
    df = DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", "flag")
    return _clean(df, CleaningOp("impute_categorical", "flag"))


@query("clean_clip_iqr", f"""WITH v AS ({DIRTY.sql}), q AS (SELECT quantile_cont(disc, 0.25) AS a, quantile_cont(disc, 0.75) AS b FROM v)
SELECT {KEYS}, round(CASE WHEN disc IS NULL THEN NULL ELSE least(greatest(disc, a - 1.5 * (b - a)), b + 1.5 * (b - a)) END, 6) AS disc FROM v, q""")
def clean_clip_iqr(spark, d):
    df = DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", "disc")
    return rounded(_clean(df, CleaningOp("handle_outliers", "disc", {"method": "clip"})), 6, "disc")


@query("clean_dedupe", f"SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM ({COPIES.sql}) v")
def clean_dedupe(spark, d):
    return _clean(COPIES.frame(spark, d), CleaningOp("remove_duplicates", "all"))


@query("clean_remove_columns", f"SELECT {KEYS}, qty FROM ({DIRTY.sql}) v")
def clean_remove_columns(spark, d):
    return _clean(DIRTY.frame(spark, d), *[CleaningOp("remove_column", c) for c in ("disc", "flag", "code", "sparse", "fixed", "unknown")])


@query("clean_numeric_string", f"SELECT {KEYS}, try_cast(trim(code) AS DOUBLE) AS code FROM ({DIRTY.sql}) v")
def clean_numeric_string(spark, d):
    df = DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", "code")
    return _clean(df, CleaningOp("convert_type", "code", {"target_type": "numeric"}))


@query("numeric_text_share", f"""WITH v AS ({DIRTY.sql})
SELECT 'code' AS "column", round(avg(CASE WHEN try_cast(trim(code) AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM v WHERE code IS NOT NULL
UNION ALL SELECT 'flag', round(avg(CASE WHEN try_cast(flag AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM v WHERE flag IS NOT NULL""")
def numeric_text_share(spark, d):
    shares = cleaning.numeric_text_share(DIRTY.frame(spark, d), ["code", "flag"])
    return spark.createDataFrame([(c, round(s, 6)) for c, s in shares.items()], "`column` string, share double")


@query("cleaning_plan", f"""
WITH v AS ({DIRTY.sql}), n AS (SELECT count(*) AS n FROM v),
u AS (SELECT 'disc' AS c, quantile_cont(disc, 0.25) AS a, quantile_cont(disc, 0.75) AS b FROM v),
o AS (SELECT count(*) FILTER (disc < a - 1.5 * (b - a) OR disc > b + 1.5 * (b - a)) * 100.0 / count(disc) AS pct FROM v, u),
dup AS (SELECT sum(k - 1) AS d FROM (SELECT count(*) AS k FROM v GROUP BY {KEYS}, qty, disc, flag, code, sparse, fixed) g)
SELECT 'remove_column' AS op_type, 'fixed' AS "column" UNION ALL SELECT 'remove_column', 'sparse'
UNION ALL SELECT 'remove_column', 'l_orderkey' FROM v, n GROUP BY n HAVING count(DISTINCT l_orderkey) > 0.95 * n
UNION ALL SELECT 'impute_numeric', 'qty' UNION ALL SELECT 'impute_numeric', 'disc'
UNION ALL SELECT 'impute_categorical', 'flag' UNION ALL SELECT 'impute_categorical', 'code'
UNION ALL SELECT 'remove_duplicates', 'all' FROM dup WHERE d > 0
UNION ALL SELECT 'handle_outliers', 'disc' FROM o WHERE pct > 5
UNION ALL SELECT 'convert_type', 'code'
""")
def cleaning_plan(spark, d):
    df = DIRTY.frame(spark, d)
    return cleaning.plan_frame(df, cleaning.plan_cleaning(df)).select("op_type", "column")


@query("clean_by_plan", f"""
WITH v AS ({DIRTY.sql}), f AS (SELECT l_orderkey, l_linenumber,
  coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM v)) AS qty, coalesce(disc, (SELECT quantile_cont(disc, 0.5) FROM v)) AS disc,
  coalesce(flag, (SELECT flag FROM v WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag,
  coalesce(code, (SELECT code FROM v WHERE code IS NOT NULL GROUP BY code ORDER BY count(*) DESC, code LIMIT 1)) AS code FROM v),
g AS (SELECT DISTINCT * FROM f), q AS (SELECT quantile_cont(disc, 0.25) AS a, quantile_cont(disc, 0.75) AS b FROM g)
SELECT l_orderkey, l_linenumber, qty, round(least(greatest(disc, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) AS disc, flag,
       try_cast(trim(code) AS DOUBLE) AS code FROM g, q
""")
def clean_by_plan(spark, d):
    df = DIRTY.frame(spark, d)
    facts = profile.table_facts(df)
    return rounded(_clean(df, *cleaning.plan_cleaning(df, facts=facts), facts=facts), 6, "disc")


@query("cleaning_summary", f"""
SELECT count(*) AS rows_before, count(DISTINCT o_orderkey) AS rows_after, CAST(5 AS BIGINT) AS columns_before, CAST(4 AS BIGINT) AS columns_after,
       count(*) - count(DISTINCT o_orderkey) AS rows_removed, CAST(1 AS BIGINT) AS columns_removed, CAST(0 AS BIGINT) AS nulls_filled, CAST(2 AS BIGINT) AS operations,
       round((count(*) * 5.0 - count(DISTINCT o_orderkey) * 4.0) * 100 / (count(*) * 5.0), 6) AS reduction_pct FROM ({COPIES.sql}) v
""")
def cleaning_summary(spark, d):
    df = COPIES.frame(spark, d)
    done = cleaning.apply_cleaning(df, [CleaningOp("remove_duplicates", "all"), CleaningOp("remove_column", "o_totalprice")])
    return rounded(cleaning.cleaning_summary(df, done), 6, "reduction_pct")


@query("cleaning_advice", f"""
WITH v AS ({DIRTY.sql}), n AS (SELECT count(*) AS n, count(*) - count(qty) AS f FROM v)
SELECT 'warning' AS kind, 'many_nulls_filled' AS code, CAST(f AS DOUBLE) AS value FROM n WHERE f > n * 0.1
UNION ALL SELECT 'suggestion', 'review_removed_columns', 2.0
UNION ALL SELECT 'suggestion', 'review_filled_nulls', CAST(f AS DOUBLE) FROM n WHERE f > 0""")
def cleaning_advice(spark, d):
    df = DIRTY.frame(spark, d)
    done = cleaning.apply_cleaning(df, [CleaningOp("remove_column", "fixed"), CleaningOp("remove_column", "sparse"),
                                        CleaningOp("impute_numeric", "qty", {"strategy": "median"})])
    return cleaning.cleaning_advice(cleaning.cleaning_summary(df, done)).drop("ordinal")


@query("cleaning_replay", f"""
WITH v AS ({DIRTY.sql}), t AS (SELECT * FROM v WHERE l_orderkey % 2 = 0)
SELECT {KEYS}, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM t)) AS qty,
  coalesce(flag, (SELECT flag FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM v WHERE l_orderkey % 2 = 1""")
def cleaning_replay(spark, d):
    df = DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", "qty", "flag")
    ops = [CleaningOp("impute_numeric", "qty", {"strategy": "median"}), CleaningOp("impute_categorical", "flag")]
    train, rest = df.where("l_orderkey % 2 = 0"), df.where("l_orderkey % 2 = 1")
    fitted = cleaning.apply_cleaning(train, ops).applied
    stored = cleaning.plan_from_frame(cleaning.plan_frame(df, fitted))
    return _clean(rest, *stored)


@query("cleaning_hook", f"SELECT {KEYS}, qty * 2 AS qty FROM ({DIRTY.sql}) v WHERE qty IS NOT NULL")
def cleaning_hook(spark, d):
    df = DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", "qty")
    return _clean(df, transforms=[lambda t: t.where("qty IS NOT NULL"), lambda t: t.withColumn("qty", F.col("qty") * 2)])


@query("cleaning_skip_types", f"SELECT 'impute_numeric' AS op_type, 'qty' AS \"column\" UNION ALL SELECT 'impute_categorical', 'flag'")
def cleaning_skip_types(spark, d):
    df = DIRTY.frame(spark, d).select("qty", "flag", "fixed")
    facts = profile.table_facts(df, duplicates=False, moments=False)
    ops = cleaning.skip_types(cleaning.plan_cleaning(df, facts=facts), ["remove_column", "handle_outliers"])
    return cleaning.plan_frame(df, ops).select("op_type", "column")


# Selection ---------------------------------------------------------------------------------------

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "price2", "line", "y")


@query("variance_filter", f"WITH v AS ({SELECTABLE.sql}) SELECT feature, round(variance, 4) AS variance, variance > 0.01 AS kept FROM (" + union_sql(
    f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM v" for c in NUMERIC) + ") t")
def variance_filter(spark, d):
    out = selection.variances(SELECTABLE.frame(spark, d)).withColumn("kept", F.col("variance") > selection.MIN_VARIANCE)
    return rounded(out, 4, "variance")


@query("corr_filter", f"""WITH v AS ({RELATED.sql}) SELECT 'net' AS feature FROM v
HAVING corr(l_extendedprice, net) > 0.95 AND abs(corr(net, gross)) < abs(corr(l_extendedprice, gross))""")
def corr_filter(spark, d):
    df = RELATED.frame(spark, d).select("l_quantity", "l_extendedprice", "net", "l_tax", "gross")
    return selection.select_features(df, "gross", methods=["correlation"]).frame().where("NOT kept").select("feature")


def _flagged_sql(names, source: str) -> str:
    """Later columns of pairs above the limit, the first half of them in column order."""
    pairs = union_sql(f"SELECT {j} AS place, '{b}' AS feature, corr({a}, {b}) AS r FROM v" for j, b in enumerate(names) for a in names[:j])
    return (f"WITH v AS ({source}), f AS (SELECT DISTINCT place, feature FROM ({pairs}) p WHERE abs(r) > 0.95) "
            "SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY place) AS k, count(*) OVER () AS n FROM f) t WHERE k <= n // 2")


@query("corr_filter_no_target", _flagged_sql(("l_extendedprice", "net", "gross", "l_tax"), RELATED.sql))
def corr_filter_no_target(spark, d):
    df = RELATED.frame(spark, d).select("l_extendedprice", "net", "gross", "l_tax")
    return selection.select_features(df, methods=["correlation"]).frame().where("NOT kept").select("feature")


def _anova_sql(names, target: str) -> str:
    def one(c):
        return (f"SELECT '{c}' AS feature, round((sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))), 4) AS score FROM "
                f"(SELECT {target}, count(*) AS n, avg(coalesce({c}, 0)) AS m, var_pop(coalesce({c}, 0)) AS vp FROM v GROUP BY {target}) a, "
                f"(SELECT avg(coalesce({c}, 0)) AS g FROM v) b")
    return f"WITH v AS ({SELECTABLE.sql}) " + union_sql(one(c) for c in names)


@query("anova_f", _anova_sql(NUMERIC, "l_linestatus"))
def anova_f(spark, d):
    return rounded(selection.anova_f(SELECTABLE.frame(spark, d), "l_linestatus"), 4, "score")


@query("f_regression", f"WITH v AS ({SELECTABLE.sql}), f AS (SELECT " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMERIC) + " FROM v) " + union_sql(
    f"SELECT '{c}' AS feature, round(r * r / (1 - r * r) * (n - 2), 3) AS score FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM f) t"
    for c in NUMERIC if c not in ("l_extendedprice", "price2")))
def f_regression(spark, d):
    names = [c for c in NUMERIC if c not in ("l_extendedprice", "price2")]
    return rounded(selection.f_regression(SELECTABLE.frame(spark, d), "l_extendedprice", names), 3, "score")


@query("select_univariate")
def select_univariate(spark, d):
    df = SELECTABLE.frame(spark, d).drop("y")
    return rounded(selection.select_features(df, "l_linestatus", methods=["univariate"]).frame(), 4, "score")


@query("feature_addback", f"""WITH s AS ({_anova_sql(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "line", "y"), "l_linestatus")})
SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY score DESC) AS r FROM s) t WHERE r <= 6""")
def feature_addback(spark, d):
    df = SELECTABLE.frame(spark, d).drop("price2", "l_returnflag")
    done = selection.select_features(df, "l_linestatus", methods=["univariate"])
    return done.frame().where("kept").select("feature")


@query("select_features", f"SELECT l_quantity, l_extendedprice, l_returnflag, y FROM ({SELECTABLE.sql}) v")
def select_features(spark, d):
    df = SELECTABLE.frame(spark, d).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "y")
    return selection.select_features(df, "y", methods=["variance"], exclude=["l_discount", "l_tax"]).data


@query("select_all_methods")
def select_all_methods(spark, d):
    return rounded(selection.select_features(SELECTABLE.frame(spark, d), "y").frame(), 3, "score")


_SELECTED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")
_SUMMARY = f"""WITH v AS ({SELECTABLE.sql}), s AS (SELECT CAST({len(_SELECTED)} AS BIGINT) AS features_before, CAST(count(*) FILTER (x <= 0.01) AS BIGINT) AS removed
 FROM ({union_sql(f"SELECT var_pop({c}) AS x FROM v" for c in _SELECTED)}) t),
r AS (SELECT features_before, features_before - removed AS features_after, removed, removed * 100.0 / features_before AS reduction_pct,
 CAST(CASE WHEN removed > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_methods FROM s)"""


def _low_variance(spark, d):
    return selection.select_features(SELECTABLE.frame(spark, d).select(*_SELECTED, "y"), "y", methods=["variance"])


@query("selection_summary", f"{_SUMMARY} SELECT * FROM r")
def selection_summary(spark, d):
    return selection.selection_summary(_low_variance(spark, d)).drop("methods")


@query("selection_advice", f"""{_SUMMARY} SELECT kind, code, value FROM (
 SELECT 'warning' AS kind, 'very_large_reduction' AS code, reduction_pct AS value, reduction_pct > 70 AS fires FROM r
 UNION ALL SELECT 'suggestion', 'large_reduction', reduction_pct, reduction_pct > 60 FROM r
 UNION ALL SELECT 'suggestion', 'single_method', n_methods, n_methods = 1 FROM r
 UNION ALL SELECT 'suggestion', 'few_features', features_after, features_after < 5 FROM r
 UNION ALL SELECT 'review', 'needs_review', 1.0, reduction_pct > 50 FROM r) t WHERE fires""")
def selection_advice(spark, d):
    return selection.selection_advice(selection.selection_summary(_low_variance(spark, d))).drop("ordinal")


# Encoding --------------------------------------------------------------------------------------

@query("hidden_categorical", f"WITH v AS ({DIRTY.sql}) " + union_sql(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND try_cast(trim({c}) AS DOUBLE) IS NULL) AS bad_values FROM v" for c in ("flag", "code")))
def hidden_categorical(spark, d):
    return encoding.non_numeric_text(DIRTY.frame(spark, d), ["flag", "code"])


@query("encode_missing", f"SELECT {KEYS}, coalesce(flag, '__MISSING__') AS flag FROM ({DIRTY.sql}) v")
def encode_missing(spark, d):
    return DIRTY.frame(spark, d).select("l_orderkey", "l_linenumber", encoding.with_missing(F.col("flag")).alias("flag"))


def _encode(df, *names):
    return encoding.apply_encoders(df, encoding.fit_encoders(df, names=names))


@query("encode_constant", "SELECT l_orderkey, l_linenumber, 0 AS same FROM lineitem")
def encode_constant(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("x").alias("same"))
    return _encode(df, "same")


@query("encode_binary", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 0 ELSE 1 END AS l_linestatus FROM lineitem")
def encode_binary(spark, d):
    return _encode(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus")


@query("encode_label", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority, "
       "CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus FROM orders")
def encode_label(spark, d):
    return _encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus")


@query("encode_frequency", "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS p_name, count(*) OVER (PARTITION BY p_brand) AS p_brand FROM part")
def encode_frequency(spark, d):
    return _encode(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand")


@query("encode_digits", "SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS BIGINT), 0) AS brand_no FROM part")
def encode_digits(spark, d):
    return encoding.encode_digits(table(spark, d, "part"), "p_brand", "brand_no").select("p_partkey", "brand_no")


@query("encode_hash")
def encode_hash(spark, d):
    return encoding.encode_hash(table(spark, d, "part"), "p_name", "code").select("p_partkey", "code")


@query("encode_table", """SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
  o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS even, o_orderpriority FROM orders""")
def encode_table(spark, d):
    df = table(spark, d, "orders").withColumn("even", F.col("o_custkey") % 2 == 0)
    return encoding.encode_table(df, "o_orderpriority")


@query("encode_label_any_size", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM customer")
def encode_label_any_size(spark, d):
    from wideloom.operators.models import label_encode
    return label_encode(table(spark, d, "customer"), "c_name", "code").select("c_custkey", "code")


# Features --------------------------------------------------------------------------------------

def _features(df, *ops):
    return features.apply_features(df, list(ops))[0]


@query("feat_ratio", f"""SELECT {KEYS}, round(coalesce(qty, 0) / CASE WHEN coalesce(disc, 1) = 0 THEN 1e-8 ELSE coalesce(disc, 1) END, 4) AS qty_to_disc_ratio FROM ({DIRTY.sql}) v""")
def feat_ratio(spark, d):
    df = _features(DIRTY.frame(spark, d), FeatureOp("ratio", "qty_to_disc_ratio", ("qty", "disc")))
    return rounded(df.select("l_orderkey", "l_linenumber", "qty_to_disc_ratio"), 4, "qty_to_disc_ratio")


@query("feat_bins", f"""WITH v AS ({DIRTY.sql}), r AS (SELECT min(qty) AS lo, max(qty) AS hi FROM v)
SELECT {KEYS}, CASE WHEN qty IS NULL THEN -1 ELSE CAST(least(greatest(ceil((qty - lo) / ((hi - lo) / 5)) - 1, 0), 4) AS INTEGER) END AS qty_binned FROM v, r""")
def feat_bins(spark, d):
    df = _features(DIRTY.frame(spark, d), FeatureOp("binning", "qty_binned", ("qty",), {"bins": "5"}))
    return df.select("l_orderkey", "l_linenumber", "qty_binned")


@query("feat_bins_quantile", "SELECT o_orderkey, " + " + ".join(f"CASE WHEN o_totalprice > e{i} THEN 1 ELSE 0 END" for i in range(1, 5)) +
       " AS price_bin FROM orders, (SELECT " + ", ".join(f"quantile_cont(o_totalprice, {i / 5}) AS e{i}" for i in range(1, 5)) + " FROM orders) e")
def feat_bins_quantile(spark, d):
    df = _features(table(spark, d, "orders"), FeatureOp("binning", "price_bin", ("o_totalprice",), {"bins": "5", "strategy": "quantile"}))
    return df.select("o_orderkey", "price_bin")


@query("feat_log", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal_log FROM customer")
def feat_log(spark, d):
    df = _features(table(spark, d, "customer"), FeatureOp("log_transform", "c_acctbal_log", ("c_acctbal",)))
    return rounded(df.select("c_custkey", "c_acctbal_log"), 6, "c_acctbal_log")


@query("feat_interactions", f"SELECT {KEYS}, round(coalesce(qty, 0) * coalesce(disc, 0), 6) AS poly_qty_disc, round(coalesce(qty, 0) * l_linenumber, 6) AS poly_qty_l_linenumber, "
       f"round(coalesce(disc, 0) * l_linenumber, 6) AS poly_disc_l_linenumber FROM ({DIRTY.sql}) v")
def feat_interactions(spark, d):
    df = _features(DIRTY.frame(spark, d), FeatureOp("polynomial", "polynomial_features", ("qty", "disc", "l_linenumber")))
    names = ("poly_qty_disc", "poly_qty_l_linenumber", "poly_disc_l_linenumber")
    return rounded(df.select("l_orderkey", "l_linenumber", *names), 6, *names)


@query("feat_freq", f"""WITH v AS ({DIRTY.sql}) SELECT {KEYS}, round(CASE WHEN flag IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY flag) * 1.0 / (SELECT count(*) FROM v) END, 6) AS flag_frequency FROM v""")
def feat_freq(spark, d):
    df = _features(DIRTY.frame(spark, d), FeatureOp("frequency_encoding", "flag_frequency", ("flag",)))
    return rounded(df.select("l_orderkey", "l_linenumber", "flag_frequency"), 6, "flag_frequency")


_PRESENT = "((CASE WHEN qty IS NULL THEN 0 ELSE 1 END) + (CASE WHEN disc IS NULL THEN 0 ELSE 1 END) + 1)"
_SUM = "(coalesce(qty, 0) + coalesce(disc, 0) + l_linenumber)"


@query("feat_row_agg", f"""SELECT {KEYS}, round(s, 6) AS numeric_sum, round(s / p, 6) AS numeric_mean,
  round(CASE WHEN p > 1 THEN sqrt((coalesce(power(qty - s / p, 2), 0) + coalesce(power(disc - s / p, 2), 0) + power(l_linenumber - s / p, 2)) / (p - 1)) ELSE 0 END, 6) AS numeric_std
FROM (SELECT *, {_SUM} AS s, CAST({_PRESENT} AS DOUBLE) AS p FROM ({DIRTY.sql}) v) t""")
def feat_row_agg(spark, d):
    ops = [FeatureOp("aggregation", f"numeric_{how}", ("qty", "disc", "l_linenumber"), {"operation": how}) for how in ("sum", "mean", "std")]
    names = ("numeric_sum", "numeric_mean", "numeric_std")
    return rounded(_features(DIRTY.frame(spark, d), *ops).select("l_orderkey", "l_linenumber", *names), 6, *names)


# A column that is skewed and one that is not, a text with many values and one with two.
_PLANNED = """SELECT p_size, p_retailprice, CASE WHEN p_partkey % 40 = 0 THEN p_retailprice * 100 ELSE p_retailprice END AS peaked,
 p_brand, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part"""
_NUMBERS, _TEXTS = ("p_size", "p_retailprice", "peaked"), ("p_brand", "kind")


def _plan_sql() -> str:
    """The operations of an unlimited plan: which logs and frequencies it has follows from the rows."""
    fixed = [("ratio", f"{a}_to_{b}_ratio") for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1:]] + [("binning", f"{c}_binned") for c in _NUMBERS]
    parts = [f"SELECT {i} AS place, '{kind}' AS op_type, '{name}' AS name, 1 AS adds" for i, (kind, name) in enumerate(fixed)]
    parts += [f"SELECT {20 + i}, 'log_transform', '{c}_log', 1 FROM v HAVING min({c}) > 0 AND abs(skewness({c})) > 1" for i, c in enumerate(_NUMBERS)]
    parts += ["SELECT 30, 'polynomial', 'polynomial_features', 3"]
    parts += [f"SELECT {40 + i}, 'frequency_encoding', '{c}_frequency', 1 FROM v HAVING count(DISTINCT {c}) > 2" for i, c in enumerate(_TEXTS)]
    parts += [f"SELECT {50 + i}, 'aggregation', 'numeric_{how}', 1" for i, how in enumerate(("sum", "mean"))]
    return f"WITH v AS ({_PLANNED}), p AS ({union_sql(parts)})"


def _planned(spark, d, **limits):
    df = spark.sql(_PLANNED.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    return df, features.plan_features(df, **({"max_new_ratio": None} | limits))


@query("feature_plan", f"{_plan_sql()} SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS ordinal, op_type, name FROM p")
def feature_plan(spark, d):
    df, ops = _planned(spark, d)
    return features.feature_log(df, ops).select("ordinal", "op_type", "name")


@query("feature_plan_left_out", f"{_plan_sql()} SELECT op_type, name FROM (SELECT *, row_number() OVER (ORDER BY place) AS k FROM p) t WHERE k > 5")
def feature_plan_left_out(spark, d):
    """What the limit of the width cuts from the plan."""
    left_out: list[FeatureOp] = []
    df, _ = _planned(spark, d, max_new_ratio=0.5, left_out=left_out)
    return features.feature_log(df, left_out).select("op_type", "name")


@query("feature_plan_wide")
def feature_plan_wide(spark, d):
    df = table(spark, d, "events").withColumn("v2", F.col("value") + 1).withColumn("v3", F.col("value") * 3)
    return features.feature_log(df, features.plan_features(df, max_new_ratio=5.0)).select("ordinal", "op_type", "name")


@query("skip_feature_ops", f"{_plan_sql()} SELECT op_type, name FROM p WHERE op_type <> 'binning' AND name <> 'p_size_to_peaked_ratio'")
def skip_feature_ops(spark, d):
    df, ops = _planned(spark, d, skip=["ratio: p_size_to_peaked_ratio"], skip_types=["binning"])
    return features.feature_log(df, ops).select("op_type", "name")


@query("feature_hook", "SELECT p_partkey, round(p_retailprice / p_size, 6) AS unit_price FROM part")
def feature_hook(spark, d):
    out, _ = features.apply_features(table(spark, d, "part"), [], ["p_retailprice / p_size AS unit_price"])
    return rounded(out.select("p_partkey", "unit_price"), 6, "unit_price")


_APPLIED = f"""{_plan_sql()}, s AS (SELECT CAST(5 AS BIGINT) AS columns_before, CAST(5 + sum(adds) AS BIGINT) AS columns_after, CAST(sum(adds) AS BIGINT) AS features_added,
 count(*) AS succeeded, CAST(1 AS BIGINT) AS failed, count(DISTINCT op_type) AS op_types FROM p)"""


def _applied(spark, d):
    """The whole plan, and one operation that a text column cannot have."""
    df, ops = _planned(spark, d)
    out, done = features.apply_features(df, [*ops, FeatureOp("log_transform", "bad", ("p_brand",))])
    return features.feature_summary(df, out, done)


@query("feature_summary", f"{_APPLIED} SELECT * FROM s")
def feature_summary(spark, d):
    return _applied(spark, d)


@query("feature_advice", f"""{_APPLIED} SELECT kind, code, CAST(value AS DOUBLE) AS value FROM (
 SELECT 'suggestion' AS kind, 'failed_operations' AS code, failed AS value, failed > 0 AS fires FROM s
 UNION ALL SELECT 'suggestion', 'many_features', features_added, features_added > 20 FROM s
 UNION ALL SELECT 'suggestion', 'no_features', features_added, features_added = 0 FROM s
 UNION ALL SELECT 'suggestion', 'little_variety', op_types, op_types < 3 FROM s
 UNION ALL SELECT 'review', 'needs_review', features_added, features_added > 10 FROM s
 UNION ALL SELECT 'warning', 'wide_growth', features_added, features_added > columns_before * 0.3 FROM s) t WHERE fires""")
def feature_advice(spark, d):
    return features.feature_advice(_applied(spark, d)).drop("ordinal")


@query("zscore", "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice_z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) t")
def zscore(spark, d):
    out = scaling.zscore(table(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", "o_totalprice_z")
    return rounded(out, 6, "o_totalprice_z")


@query("leakage_risk", f"WITH v AS ({RELATED.sql}) SELECT * FROM (" + union_sql(
    f"SELECT '{c}' AS \"column\", round(abs(corr({c}, l_extendedprice)), 6) AS strength FROM v" for c in ("l_quantity", "net", "gross", "l_tax")) + ") t WHERE strength > 0.99")
def leakage_risk(spark, d):
    return rounded(scaling.leakage_risk(RELATED.frame(spark, d), "l_extendedprice", ["l_quantity", "net", "gross", "l_tax"]), 6, "strength")


_LEAK = ("l_quantity", "l_extendedprice", "l_tax", "days", "l_linenumber")

@query("leakage_risk_binary", "WITH v AS (SELECT *, CAST(l_returnflag = 'N' AS INTEGER) AS y, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS days FROM lineitem), areas AS (" + union_sql(
    f"SELECT '{c}' AS \"column\", sum(pos * (below - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS a, (SELECT abs(corr({c}, y)) FROM v) AS r FROM "
    f"(SELECT *, CAST(sum(neg) OVER (ORDER BY x) AS DOUBLE) AS below FROM (SELECT {c} AS x, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM v "
    f"WHERE {c} IS NOT NULL AND y IS NOT NULL GROUP BY 1)) g" for c in _LEAK) + ") SELECT \"column\", round(greatest(a, 1 - a, r), 6) AS strength FROM areas WHERE greatest(a, 1 - a, r) > 0.5")
def leakage_risk_binary(spark, d):
    """How far each column alone tells rows apart, for a 0/1 target; all curves in one pass."""
    rows = table(spark, d, "lineitem").selectExpr("int(l_returnflag = 'N') AS y", *[c for c in _LEAK if c != "days"], "datediff(l_shipdate, DATE '1992-01-01') AS days")
    return rounded(scaling.leakage_risk(rows, "y", list(_LEAK), above=0.5), 6, "strength")


@query("data_sufficiency", "SELECT 'rows' AS \"check\", CAST(count(*) AS DOUBLE) AS value, count(*) >= 500 AS passed FROM part "
       "UNION ALL SELECT 'signal', round(greatest(abs(corr(p_partkey, p_retailprice)), abs(corr(p_size, p_retailprice))), 6), "
       "greatest(abs(corr(p_partkey, p_retailprice)), abs(corr(p_size, p_retailprice))) >= 0.05 FROM part")
def data_sufficiency(spark, d):
    return rounded(scaling.data_sufficiency(table(spark, d, "part"), "p_retailprice"), 6, "value")

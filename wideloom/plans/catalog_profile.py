"""Queries: scans, validation and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wideloom.operators import profile, quality, relations
from wideloom.operators.counts import duplicate_rows
from wideloom.operators.neighbour_information import neighbour_information
from wideloom.plans.inputs import COPIES, DIRTY, RELATED
from wideloom.plans.registry import query, rounded, table, union_sql
from wideloom.session import shared_dir
from wideloom.sources import store, tables

LINEITEM_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _numeric_sql(source: str, names, stats=profile.NUMERIC_STATS) -> str:
    def one(c):
        q = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"
        formulas = {
            "count": f"count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
            "q25": f"quantile_cont({c}, 0.25)", "median": f"quantile_cont({c}, 0.5)", "q75": f"quantile_cont({c}, 0.75)",
            "max": f"max({c})", "skewness": f"skewness({c})", "kurtosis": f"kurtosis({c})",
            "zeros": f"count(*) FILTER ({c} = 0)",
            "outliers": f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))",
        }
        return union_sql(f"SELECT '{c}' AS \"column\", '{s}' AS stat, round(CAST({formulas[s]} AS DOUBLE), 4) AS value "
                         f"FROM {source}, {q} q" for s in stats)
    return union_sql(one(c) for c in names)


@query("profile_numeric", _numeric_sql("lineitem", LINEITEM_NUMERIC))
def profile_numeric(spark, d):
    return rounded(profile.profile_numeric(table(spark, d, "lineitem")), 4, "value")


@query("profile_numeric_nulls", f"WITH v AS ({DIRTY.sql}) " + _numeric_sql("v", ("qty", "disc", "sparse")))
def profile_numeric_nulls(spark, d):
    return rounded(profile.profile_numeric(DIRTY.frame(spark, d), ["qty", "disc", "sparse"]), 4, "value")


@query("outliers_iqr", union_sql(
    f"SELECT '{c}' AS \"column\", round(q1, 6) AS q25, round(q3, 6) AS q75, "
    f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers "
    f"FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}) q GROUP BY q1, q3"
    for t, c in (("customer", "c_acctbal"), ("orders", "o_totalprice"), ("events", "value"))))
def outliers_iqr(spark, d):
    out = None
    for t, c in (("customer", "c_acctbal"), ("orders", "o_totalprice"), ("events", "value")):
        one = profile.outliers_iqr(table(spark, d, t), [c])
        out = one if out is None else out.unionByName(one)
    return rounded(out, 6, "q25", "q75")


@query("table_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def table_shape(spark, d):
    return profile.shape(table(spark, d, "lineitem"))


DIRTY_COLUMNS = ("l_orderkey", "l_linenumber", "qty", "disc", "flag", "code", "sparse", "fixed")


def _null_sql() -> str:
    return f"WITH v AS ({DIRTY.sql}) " + union_sql(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM v" for c in DIRTY_COLUMNS)


@query("null_profile", _null_sql())
def null_profile(spark, d):
    return rounded(profile.null_profile(DIRTY.frame(spark, d)), 6, "null_pct")


@query("null_top20", f"SELECT * FROM ({_null_sql()}) t WHERE null_pct > 0 ORDER BY null_pct DESC, \"column\" LIMIT 20")
def null_top20(spark, d):
    return rounded(profile.top_null_columns(DIRTY.frame(spark, d)), 6, "null_pct")


@query("high_null_columns", f"SELECT * FROM ({_null_sql()}) t WHERE null_pct > 50")
def high_null_columns(spark, d):
    return rounded(profile.high_null_columns(DIRTY.frame(spark, d)), 6, "null_pct")


@query("overall_null_pct", f"SELECT CAST(sum(null_count) AS BIGINT) AS null_cells, CAST(sum(n) AS BIGINT) AS cells, "
       f"round(sum(null_count) * 100.0 / sum(n), 6) AS null_pct FROM "
       f"(SELECT null_count, (SELECT count(*) FROM lineitem) AS n FROM ({_null_sql()}) a) t")
def overall_null_pct(spark, d):
    return rounded(profile.overall_nulls(DIRTY.frame(spark, d)), 6, "null_pct")


@query("duplicate_rows", f"SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM ({COPIES.sql}) v "
       "GROUP BY o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey) g")
def duplicates(spark, d):
    return duplicate_rows(COPIES.frame(spark, d))


def _flags_sql(source: str, names, text) -> str:
    return union_sql(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values, "
        f"(count(*) - count({c})) * 100.0 / count(*) > 50 AS is_high_null, count(DISTINCT {c}) <= 1 AS is_constant, "
        f"{'count(DISTINCT ' + c + ') > 100' if c in text else 'false'} AS is_high_cardinality, "
        f"count(DISTINCT {c}) * 1.0 / count(*) > 0.95 AS is_identifier FROM {source}" for c in names)


@query("distinct_flags", _flags_sql("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), ("c_name", "c_mktsegment")))
def distinct_flags(spark, d):
    return profile.distinct_flags(table(spark, d, "customer"))


@query("distinct_flags_nulls", f"WITH v AS ({DIRTY.sql}) " + _flags_sql("v", DIRTY_COLUMNS, ("flag", "code")))
def distinct_flags_nulls(spark, d):
    return profile.distinct_flags(DIRTY.frame(spark, d))


def _categorical_sql(source: str, names) -> str:
    return union_sql(
        f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique_values, "
        f"round(count(*) * 1.0 / sum(n), 6) AS cardinality, "
        f"first(v ORDER BY n DESC, v) AS top, CAST(max(n) AS BIGINT) AS freq, round(max(n) * 100.0 / sum(n), 6) AS mode_pct, "
        f"round(-sum((n * 1.0 / tot) * log2(n * 1.0 / tot + 1e-10)), 6) AS entropy "
        f"FROM (SELECT {c} AS v, count(*) AS n, sum(count(*)) OVER () AS tot FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) t"
        for c in names)


@query("categorical_profile", _categorical_sql("documents", ("lang", "source")))
def categorical_profile(spark, d):
    return rounded(profile.categorical_profile(table(spark, d, "documents"), ["lang", "source"]), 6, "cardinality", "mode_pct", "entropy")


@query("categorical_profile_wide", f"WITH v AS ({DIRTY.sql}) " + union_sql([
    _categorical_sql("part", ("p_name", "p_brand", "p_type")), _categorical_sql("v", ("flag", "code"))]))
def categorical_profile_wide(spark, d):
    both = profile.categorical_profile(table(spark, d, "part")).unionByName(profile.categorical_profile(DIRTY.frame(spark, d)))
    return rounded(both, 6, "cardinality", "mode_pct", "entropy")


def _top_sql(source: str, names) -> str:
    return union_sql(
        f"SELECT '{c}' AS \"column\", rank, v AS value, n AS cnt FROM (SELECT {c} AS v, count(*) AS n, "
        f"row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) t WHERE rank <= 10"
        for c in names)


@query("top_values", _top_sql("part", ("p_name", "p_brand", "p_type")))
def top_values(spark, d):
    return profile.top_values(table(spark, d, "part"))


@query("memory_estimate", "SELECT CAST(sum(8 + 4 + 8 + strlen(c_name) + strlen(c_mktsegment)) AS BIGINT) AS bytes, "
       "round(sum(8 + 4 + 8 + strlen(c_name) + strlen(c_mktsegment)) / 1048576.0, 6) AS memory_mb FROM customer")
def memory_estimate(spark, d):
    return rounded(profile.memory_estimate(table(spark, d, "customer")), 6, "memory_mb")


@query("dtype_counts", """SELECT CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR column_type LIKE 'DECIMAL%' THEN 'numeric'
  WHEN column_type = 'VARCHAR' THEN 'categorical' WHEN column_type = 'DATE' OR column_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE column_type END AS family,
  count(*) AS n_columns, (SELECT count(*) FROM lineitem) AS n_rows FROM (DESCRIBE SELECT * FROM lineitem) GROUP BY family""")
def dtype_counts(spark, d):
    return profile.dtype_counts(table(spark, d, "lineitem"))


def _summary_sql(source: str, names, first=None, digits=1) -> str:
    return union_sql(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{f}' AS family, count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS unique_values, round((count(*) - count({c})) * 100.0 / count(*), {digits}) AS null_pct FROM {source}"
        for i, (c, f) in enumerate(names))


PART_COLUMNS = (("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"), ("p_type", "categorical"),
                ("p_size", "numeric"), ("p_retailprice", "numeric"))


@query("column_summary", _summary_sql("part", PART_COLUMNS))
def column_summary(spark, d):
    return profile.column_summary(table(spark, d, "part"))


@query("column_info", f"WITH v AS ({DIRTY.sql}) " + _summary_sql("v", (
    ("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("qty", "numeric"), ("disc", "numeric"), ("flag", "categorical"),
    ("code", "categorical"), ("sparse", "numeric"), ("fixed", "numeric")), digits=2))
def column_info(spark, d):
    return profile.column_summary(DIRTY.frame(spark, d), digits=2)


@query("preview_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_rows(spark, d):
    return profile.preview(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey"))


@query("target_distribution", "SELECT rank, v AS value, n AS cnt FROM (SELECT event_type AS v, count(*) AS n, "
       "row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY event_type) t WHERE rank <= 10")
def target_distribution(spark, d):
    return profile.target_distribution(table(spark, d, "events"), "event_type")


@query("target_histogram", "SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 20)), 19) AS INTEGER) + 1 AS rank, count(*) AS cnt "
       "FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) r GROUP BY 1")
def target_histogram(spark, d):
    return profile.target_distribution(table(spark, d, "customer"), "c_acctbal").select("rank", "cnt")


# Relationships ---------------------------------------------------------------------------------

RELATED_NUMERIC = ("l_quantity", "l_extendedprice", "net", "gross", "qty2", "l_discount", "l_tax")


def _pairs_sql(names, above) -> str:
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM v"
             for i, a in enumerate(names) for b in names[i + 1:]]
    return f"WITH v AS ({RELATED.sql}) SELECT * FROM ({union_sql(parts)}) p WHERE abs(r) > {above}"


@query("correlated_pairs", _pairs_sql(RELATED_NUMERIC, 0.8))
def correlated_pairs(spark, d):
    return rounded(relations.correlated_pairs(RELATED.frame(spark, d)), 6, "r")


@query("all_pair_correlations", _pairs_sql(RELATED_NUMERIC, -1))
def all_pair_correlations(spark, d):
    return rounded(relations.correlated_pairs(RELATED.frame(spark, d), RELATED_NUMERIC, above=-1), 6, "r")


@query("target_correlations", f"WITH v AS ({RELATED.sql}) " + union_sql(
    f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS correlation FROM v"
    for c in RELATED_NUMERIC if c != "l_extendedprice"))
def target_correlations(spark, d):
    return rounded(relations.target_correlations(RELATED.frame(spark, d), "l_extendedprice"), 6, "correlation")


def _cut_sql(c: str, e: str, bins: int) -> str:
    return " + ".join(f"CASE WHEN {c} > {e}{i} AND {e}{i} > {f'{e}{i - 1}' if i > 1 else f'{e}1 - 1'} THEN 1 ELSE 0 END" for i in range(1, bins))


def _edges_sql(c: str, e: str, source: str, bins: int) -> str:
    return "(SELECT " + ", ".join(f"quantile_cont({c}, {i / bins!r}) AS {e}{i}" for i in range(1, bins)) + f" FROM {source}) {e}"


def _mi_sql(names, y: str, source: str, bins: int = 10, cut_target: bool = False) -> str:
    target, more = (f"({_cut_sql(y, 'g', bins)})", f", {_edges_sql(y, 'g', source, bins)}") if cut_target else (y, "")
    return union_sql(
        f"SELECT '{c}' AS \"column\", round(greatest(sum(nxy * 1.0 / n * ln(nxy * 1.0 * n / (nx * 1.0 * ny))), 0), 6) AS mi_binned FROM ("
        f"SELECT xb, y, count(*) AS nxy, sum(count(*)) OVER (PARTITION BY xb) AS nx, sum(count(*)) OVER (PARTITION BY y) AS ny, "
        f"sum(count(*)) OVER () AS n FROM (SELECT {_cut_sql(c, 'e', bins)} AS xb, {target} AS y FROM {source}, {_edges_sql(c, 'e', source, bins)}{more}) b GROUP BY xb, y) j"
        for c in names)


@query("mi_binned", _mi_sql(("l_quantity", "l_discount", "l_tax", "l_linenumber"), "l_returnflag", "lineitem"))
def mi_binned(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(relations.mutual_information(li, "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), 6, "mi_binned")


_PSI = "(ln({n} + 6) - 1 / (2 * ({n} + 6)) - 1 / (12 * power({n} + 6, 2)) + 1 / (120 * power({n} + 6, 4)) - 1 / (252 * power({n} + 6, 6))" + "".join(
    f" - 1 / ({{n}} + {i})" for i in range(6)) + ")"


def _psi(n: str) -> str:
    return _PSI.format(n=f"CAST({n} AS DOUBLE)")


def _neighbours_sql(names, target: str, source: str) -> str:
    """Per column: distances to the three rows of the class on either side, then counts by order."""
    near = ", ".join(f"abs(x - {side}(x, {i}) OVER w)" for side in ("lag", "lead") for i in (1, 2, 3))
    return union_sql([f"""SELECT * FROM (
WITH t AS (SELECT CAST({c} AS DOUBLE) AS x, {target} AS y, count(*) OVER (PARTITION BY {target}) AS size FROM {source}),
r AS (SELECT x, y, size, list_sort(list_filter([{near}], lambda v: v IS NOT NULL)) AS d, count(*) OVER (PARTITION BY y, x) AS same
  FROM t WHERE size > 1 WINDOW w AS (PARTITION BY y ORDER BY x)),
f AS (SELECT x, size, d[least(3, len(d))] AS far, CASE WHEN d[least(3, len(d))] = 0 THEN same - 1 ELSE least(3, size - 1) END AS k FROM r),
c AS (SELECT x, sum(count(*)) OVER (ORDER BY x) AS upto, count(*) AS own FROM f GROUP BY x),
m AS (SELECT f.*, CASE WHEN far = 0 THEN s.own ELSE coalesce(a.upto, 0) - coalesce(b.upto, 0) END AS m
  FROM f JOIN c s ON s.x = f.x ASOF LEFT JOIN c a ON f.x + f.far > a.x ASOF LEFT JOIN c b ON f.x - f.far >= b.x)
SELECT '{c}' AS "column", round(greatest({_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('size')}) - avg({_psi('m')}), 0), 6) AS mi FROM m) t"""
                      for c in names])


@query("mi_neighbours", _neighbours_sql(("o_totalprice", "o_custkey", "o_orderkey"), "o_orderstatus", "orders"))
def mi_neighbours(spark, d):
    """Information of order columns about the status, estimated by neighbours."""
    found = neighbour_information(table(spark, d, "orders"), "o_orderstatus", ["o_totalprice", "o_custkey", "o_orderkey"], range_rows=5000)
    return rounded(found, 6, "mi")


@query("mi_binned_regression", _mi_sql(("l_quantity", "l_discount", "l_tax"), "l_extendedprice", "lineitem", cut_target=True))
def mi_binned_regression(spark, d):
    return rounded(relations.mutual_information(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 6, "mi_binned")


# Quality ---------------------------------------------------------------------------------------

def _imbalance_sql(source: str, c: str) -> str:
    return (f"SELECT max(n) AS largest, min(n) AS second, round(max(n) * 1.0 / min(n), 6) AS ratio, "
            f"count(*) > 1 AND max(n) * 1.0 / min(n) > 10 AS imbalanced FROM "
            f"(SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC LIMIT 2) t")


@query("class_imbalance", union_sql([_imbalance_sql("events", "event_type"), _imbalance_sql("labels", "toxic")]))
def class_imbalance(spark, d):
    both = quality.class_imbalance(table(spark, d, "events"), "event_type").unionByName(
        quality.class_imbalance(table(spark, d, "labels"), "toxic"))
    return rounded(both, 6, "ratio")


@query("ingest_validation", f"""
WITH v AS ({DIRTY.sql}), s AS (SELECT count(*) AS n, {', '.join(f'count({c}) AS f_{c}' for c in DIRTY_COLUMNS)} FROM v),
m AS (SELECT n, f_sparse, {' + '.join(f'(CASE WHEN f_{c} = 0 THEN 1 ELSE 0 END)' for c in DIRTY_COLUMNS)} AS empty,
      (n * 8.0 - ({' + '.join(f'f_{c}' for c in DIRTY_COLUMNS)})) * 100 / (n * 8.0) AS overall FROM s)
SELECT 'min_rows' AS "check", 'error' AS level, n >= 10 AS passed, CAST(n AS DOUBLE) AS detail FROM m
UNION ALL SELECT 'min_columns', 'error', true, 8.0 FROM m
UNION ALL SELECT 'empty_columns', 'warning', empty = 0, CAST(empty AS DOUBLE) FROM m
UNION ALL SELECT 'overall_nulls', 'warning', overall <= 80, round(overall, 6) FROM m
UNION ALL SELECT 'target_present', 'error', true, 1.0 FROM m
UNION ALL SELECT 'target_has_values', 'error', f_sparse > 0, CAST(f_sparse AS DOUBLE) FROM m
UNION ALL SELECT 'target_null_share', 'error', (n - f_sparse) * 100.0 / n <= 95, round((n - f_sparse) * 100.0 / n, 6) FROM m
""")
def ingest_validation(spark, d):
    return rounded(quality.ingest_validation(DIRTY.frame(spark, d), "sparse"), 6, "detail")


@query("stage_preconditions", """
WITH s AS (SELECT least(count(*), 50) AS n FROM orders)
SELECT 'profiling' AS stage, n > 0 AS ready FROM s UNION ALL SELECT 'cleaning', n > 0 FROM s UNION ALL SELECT 'selection', n > 0 FROM s
UNION ALL SELECT 'features', n > 0 FROM s UNION ALL SELECT 'modeling', n >= 50 FROM s UNION ALL SELECT 'evaluation', true FROM s
UNION ALL SELECT 'report', n > 0 FROM s""")
def stage_preconditions(spark, d):
    return quality.stage_preconditions(table(spark, d, "orders"), "o_orderstatus")


@query("quality_issues", f"""
WITH v AS ({DIRTY.sql})
SELECT 'high_null' AS issue, 'sparse' AS "column", round((count(*) - count(sparse)) * 100.0 / count(*), 6) AS value FROM v
UNION ALL SELECT 'constant', 'fixed', 1.0
UNION ALL SELECT * FROM (SELECT 'duplicate_rows', '', CAST(sum(n - 1) AS DOUBLE) AS k FROM (SELECT count(*) AS n FROM v GROUP BY ALL) g) q WHERE k > 0
UNION ALL SELECT * FROM (SELECT 'target_nulls', 'sparse', round((count(*) - count(sparse)) * 100.0 / count(*), 6) AS p FROM v) q WHERE p > 10
UNION ALL SELECT * FROM (SELECT 'class_imbalance', 'sparse', ratio FROM ({_imbalance_sql('v', 'sparse')}) i WHERE imbalanced) q
""".replace("GROUP BY ALL", "GROUP BY " + ", ".join(DIRTY_COLUMNS)))
def quality_issues(spark, d):
    return rounded(quality.quality_issues(DIRTY.frame(spark, d), "sparse"), 6, "value")


@query("profile_advice", f"""
WITH v AS ({DIRTY.sql}), n AS (SELECT count(*) AS n FROM v),
nulls AS (SELECT n * 8 - ({' - '.join(f'0 + count({c})' for c in DIRTY_COLUMNS).replace(' - 0 + ', ' + ')}) AS k FROM v, n GROUP BY n),
dup AS (SELECT CAST(coalesce(sum(k - 1), 0) AS DOUBLE) AS d FROM (SELECT count(*) AS k FROM v GROUP BY {', '.join(DIRTY_COLUMNS)}) g),
ids AS (SELECT {' + '.join(f'(CASE WHEN count(DISTINCT {c}) > 0.95 * count(*) THEN 1 ELSE 0 END)' for c in DIRTY_COLUMNS)} AS i FROM v)
SELECT 'suggestion' AS kind, 'drop_high_null' AS code, 1.0 AS value FROM n WHERE n > 0
UNION ALL SELECT 'suggestion', 'drop_constant', 1.0 FROM n WHERE n > 0
UNION ALL SELECT 'suggestion', 'drop_identifiers', CAST(i AS DOUBLE) FROM ids WHERE i > 0
UNION ALL SELECT 'warning', 'many_duplicates', d * 100 / n FROM dup, n WHERE d > n * 0.1
UNION ALL SELECT 'suggestion', 'drop_duplicates', d FROM dup WHERE d > 0
UNION ALL SELECT 'warning', 'overall_nulls', k * 100.0 / (n * 8) FROM nulls, n WHERE k * 100.0 / (n * 8) > 30
UNION ALL SELECT 'review', 'needs_review', 1.0 FROM nulls, dup, n WHERE k * 100.0 / (n * 8) > 30 OR d > n * 0.1
""")
def profile_advice(spark, d):
    df = DIRTY.frame(spark, d)
    return quality.profile_advice(df, profile.table_facts(df)).drop("ordinal")


@query("data_overview", """SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS null_cells,
  CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM part GROUP BY ALL) g) AS BIGINT) AS duplicates,
  CAST(0 AS BIGINT) AS high_null_columns, CAST(0 AS BIGINT) AS constant_columns, CAST(3 AS BIGINT) AS numeric_columns,
  CAST(3 AS BIGINT) AS categorical_columns, CAST(0 AS BIGINT) AS datetime_columns, CAST(0 AS BIGINT) AS boolean_columns,
  CAST(0 AS DOUBLE) AS null_pct, 'p_type' AS target FROM part""".replace(
    "GROUP BY ALL", "GROUP BY p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"))
def data_overview(spark, d):
    df = table(spark, d, "part")
    return quality.data_overview(df, profile.table_facts(df, moments=False), "p_type")


# Scans, projections and stored tables ------------------------------------------------------------

@query("exclude_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def exclude_columns(spark, d):
    return tables.exclude_columns(table(spark, d, "lineitem"), [
        "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate", "not_there"])


@query("retarget", "SELECT o_orderpriority, o_totalprice FROM orders")
def retarget(spark, d):
    df = table(spark, d, "orders")
    target = tables.retarget(df, "o_orderpriority", tables.retarget(df, "nothing", "o_orderstatus"))
    return df.select(target, "o_totalprice")


@query("split_xy", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def split_xy(spark, d):
    x, _ = tables.split_xy(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "o_orderstatus")
    return x


@query("family_projection", "SELECT p_partkey, p_size, p_retailprice FROM part")
def family_projection(spark, d):
    from wideloom.functions.columns import families
    df = table(spark, d, "part")
    return df.select(*families(df).numeric)


def _scratch(spark, name: str) -> str:
    """New folder for one run on the storage the session shares; Spark jobs read it back."""
    base = shared_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/wideloom-{name}-{uuid.uuid4().hex}"


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority, "
       "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey * 1.0 END AS gaps FROM orders")
def scan_csv(spark, d):
    gaps = F.when(F.col("o_orderkey") % 9 == 0, F.lit("NA")).otherwise(F.col("o_custkey").cast("string"))
    path = _scratch(spark, "orders") + ".csv"
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", gaps.alias("gaps")) \
        .write.option("header", True).csv(path)
    df = tables.read_table(spark, path)
    return rounded(df.withColumn("gaps", F.col("gaps").cast("double")), 2, "o_totalprice")


@query("scan_csv_lines", "SELECT c_custkey, c_name || chr(10) || '\"' || c_mktsegment || '\"' AS note, c_nationkey FROM customer")
def scan_csv_lines(spark, d):
    """Cells with line breaks and quotes."""
    path = _scratch(spark, "notes") + ".csv"
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('"'))
    table(spark, d, "customer").select("c_custkey", note.alias("note"), "c_nationkey").write.option("header", True).option("escape", '"').csv(path)
    return tables.read_table(spark, path).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("scan_parquet", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 25")
def scan_parquet(spark, d):
    return tables.read_table(spark, f"{d}/part.parquet").where("p_size > 25").select("p_partkey", "p_brand", "p_size")


@query("store_roundtrip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def store_roundtrip(spark, d):
    path = store.store_table(table(spark, d, "supplier"), _scratch(spark, "store"), "supplier", project_id="p1")
    return store.load_table(spark, path)


@query("file_checksums")
def file_checksums(spark, d):
    return store.file_checksums(spark, f"{d}/*.parquet")


def _fingerprint_sql(source: str, *names: str) -> str:
    fields = ", ".join(f"coalesce(length(CAST({n} AS VARCHAR)) || ':' || CAST({n} AS VARCHAR), '~')" for n in names)
    return (f"SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', {fields})), 1, 8)) AS BIGINT)) AS DECIMAL(38,0)) AS fingerprint FROM {source}")


@query("table_fingerprint", _fingerprint_sql("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
def table_fingerprint(spark, d):
    return store.table_fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("fingerprint_nulls", f"WITH v AS ({DIRTY.sql}) " + _fingerprint_sql("v", "l_orderkey", "flag", "code"))
def fingerprint_nulls(spark, d):
    """Nulls and texts with blanks in the fingerprint."""
    return store.table_fingerprint(DIRTY.frame(spark, d), ["l_orderkey", "flag", "code"])


@query("ingest_record", f"WITH v AS ({DIRTY.sql}) SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns, "
       "count(*) - count(qty) AS null_qty, count(*) - count(flag) AS null_flag FROM v")
def ingest_record(spark, d):
    return store.ingest_record(DIRTY.frame(spark, d), d).select(
        "n_rows", "n_columns", F.col("null_counts")["qty"].alias("null_qty"), F.col("null_counts")["flag"].alias("null_flag"))

"""Cleaning plan: derived from the profile by fixed rules, applied in order, replayable."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from wideloom.functions.columns import between_or_null, col, families, known, melt, number
from wideloom.functions.numbers import strip_symbols, to_number
from wideloom.functions.rules import Rule, fired
from wideloom.operators.counts import modes
from wideloom.operators.profile import ColumnFacts, TableFacts, table_facts
from wideloom.operators.quantiles import exact_quantiles, iqr_fences
from wideloom.session import cut

MAX_NULL_PCT = 90.0
OUTLIER_PCT = 5.0
NUMERIC_TEXT_SHARE = 0.8
PLAN_SCHEMA = "ordinal int, op_type string, column string, params map<string,string>, reason string"


@dataclass(frozen=True)
class CleaningOp:
    op_type: str
    column: str
    params: dict[str, str] = field(default_factory=dict)
    reason: str = ""


@dataclass(frozen=True)
class Cleaned:
    data: DataFrame
    applied: list[CleaningOp]
    failed: list[CleaningOp]
    nulls_filled: int


def numeric_text_share(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Share of non-null strings that read as numbers once ``, $ %`` are removed (all rows)."""
    names = list(names)
    if not names:
        return {}
    rows = (
        melt(df, [[col(n)] for n in names], ["t"]).where("t IS NOT NULL")
        .groupBy("ci").agg(F.avg(to_number(strip_symbols(F.col("t"))).isNotNull().cast("double")).alias("share"))
        .collect()
    )
    return {names[r["ci"]]: r["share"] for r in rows}


def plan_cleaning(df: DataFrame, target: str | None = None, facts: TableFacts | None = None) -> list[CleaningOp]:
    """Constant, null-heavy and identifier columns; imputation; copies; outliers; numeric text."""
    facts = facts or table_facts(df)
    ops: list[CleaningOp] = []
    for c in facts.constants():
        if c != target:
            ops.append(CleaningOp("remove_column", c, {}, "constant"))
    for c in facts.high_null(MAX_NULL_PCT):
        if c != target:
            ops.append(CleaningOp("remove_column", c, {"null_pct": repr(facts.columns[c].null_pct)}, "too many nulls"))
    for c in facts.identifiers():
        if c != target:
            ops.append(CleaningOp("remove_column", c, {}, "identifier"))
    gone = {o.column for o in ops}
    for c, f in facts.columns.items():
        if c in gone or not 0 < f.null_pct <= MAX_NULL_PCT:
            continue
        if f.family == "numeric":
            ops.append(CleaningOp("impute_numeric", c, {"strategy": "median", "null_pct": repr(f.null_pct)}, "nulls"))
        elif f.family == "categorical":
            ops.append(CleaningOp("impute_categorical", c, {"strategy": "mode", "null_pct": repr(f.null_pct)}, "nulls"))
    if facts.duplicates:
        ops.append(CleaningOp("remove_duplicates", "all", {"count": str(facts.duplicates)}, "repeated rows"))
    for c in facts.kinds.numeric:
        s = facts.columns[c].stats
        if c != target and s.get("outliers") and s["outliers"] * 100.0 / s["count"] > OUTLIER_PCT:
            ops.append(CleaningOp("handle_outliers", c, {"method": "clip", "outliers": str(s["outliers"])}, "outliers"))
    text = [c for c in facts.kinds.categorical if c not in gone]
    for c, share in numeric_text_share(df, text).items():
        if share > NUMERIC_TEXT_SHARE:
            ops.append(CleaningOp("convert_type", c, {"target_type": "numeric"}, "numeric text"))
    return ops


def skip_types(ops: Iterable[CleaningOp], skip: Iterable[str]) -> list[CleaningOp]:
    skipped = set(skip)
    return [o for o in ops if o.op_type not in skipped]


def plan_frame(df: DataFrame, ops: Sequence[CleaningOp]) -> DataFrame:
    """The plan as rows, to be stored with the run and replayed later."""
    rows = [(i, o.op_type, o.column, dict(o.params), o.reason) for i, o in enumerate(ops)]
    return df.sparkSession.createDataFrame(rows, PLAN_SCHEMA)


def plan_from_frame(plan: DataFrame) -> list[CleaningOp]:
    return [CleaningOp(r["op_type"], r["column"], dict(r["params"]), r["reason"])
            for r in plan.orderBy("ordinal").collect()]


def apply_cleaning(
    df: DataFrame,
    ops: Sequence[CleaningOp],
    transforms: Sequence[Callable[[DataFrame], DataFrame]] = (),
    *,
    strip: bool = False,
    keep: Sequence[str] = (),
    facts: TableFacts | None = None,
) -> Cleaned:
    """Apply the plan in order.

    ``facts`` of this very table spare the scans for its medians, quartiles and null counts; columns that a step
    has changed, and all after copies are removed, are fitted anew.

    Runs of equal operations share one fit and one ``select``.  Fitted values are written into
    the returned ``applied`` plan, so replaying that plan on another table (a test split, the
    next delivery) reuses them instead of fitting again.  Rows after de-duplication are
    materialised once if a later step has to fit on them.  ``keep`` names row keys that take no
    part in finding copies.
    """
    applied: list[CleaningOp] = []
    failed: list[CleaningOp] = []
    filled = 0
    runs = [(kind, list(run)) for kind, run in groupby(ops, key=lambda o: o.op_type)]
    column_facts = dict(facts.columns) if facts else {}
    for position, (kind, run) in enumerate(runs):
        done: list[CleaningOp] = []
        if kind == "remove_column":
            done = [o for o in run if o.column in df.columns]
            df = df.drop(*[o.column for o in done])
        elif kind == "remove_duplicates":
            df, done, column_facts = _distinct_rows(df, keep), run, {}
            refit = any(o.op_type.startswith(("handle", "impute")) and not {"low", "value"} & set(o.params)
                        for _, later in runs[position + 1:] for o in later)
            df = cut(df) if refit else df
        elif kind == "impute_numeric":
            done = _fit_numeric(df, run, column_facts)
            filled += _nulls(df, done, column_facts)
            fills = {o.column: F.coalesce(number(df, o.column), F.lit(float(o.params["value"]))) for o in done}
            df = _with(df, fills)
        elif kind == "impute_categorical":
            done = _fit_modes(df, run)
            filled += _nulls(df, done, column_facts)
            df = _with(df, {o.column: F.coalesce(col(o.column), F.lit(o.params["value"])) for o in done})
        elif kind == "handle_outliers":
            done = _fit_fences(df, run, column_facts)
            df = _with(df, {o.column: between_or_null(number(df, o.column), float(o.params["low"]), float(o.params["high"]))
                            for o in done})
        elif kind == "convert_type":
            done = [o for o in run if o.column in families(df).categorical]
            df = _with(df, {o.column: to_number(strip_symbols(col(o.column)) if strip else col(o.column)) for o in done})
        for o in done:
            column_facts.pop(o.column, None)
        applied += done
        worked = {o.column for o in done}
        failed += [o for o in run if o.column not in worked and o.column in df.columns]
    for transform in transforms:
        df = df.transform(transform)
    return Cleaned(df, applied, failed, filled)


def _distinct_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Distinct rows; row keys listed in ``keep`` do not count and the smallest one stays."""
    keep = known(keep, df)
    if not keep:
        return df.dropDuplicates()
    values = [col(c) for c in df.columns if c not in keep]
    return df.groupBy(*values).agg(*[F.min(col(c)).alias(c) for c in keep]).select(*[col(c) for c in df.columns])


def _with(df: DataFrame, changes: dict) -> DataFrame:
    return df.select(*[changes[c].alias(c) if c in changes else col(c) for c in df.columns])


def _nulls(df: DataFrame, ops: Sequence[CleaningOp], column_facts: Mapping[str, ColumnFacts]) -> int:
    counted = sum(column_facts[o.column].nulls for o in ops if o.column in column_facts)
    one = [F.count("*") - F.count(number(df, o.column) if o.op_type == "impute_numeric" else col(o.column)) for o in ops if o.column not in column_facts]
    return counted + (df.agg(sum(one, F.lit(0)).alias("n")).head()[0] if one else 0)


def _quantiles(df: DataFrame, names: Sequence[str], stats: Mapping[str, float], column_facts: Mapping[str, ColumnFacts]) -> dict[str, list]:
    """Quantiles by column; ``stats`` names those that the facts may already hold."""
    held = {c: [column_facts[c].stats.get(s) for s in stats] for c in names if c in column_facts and column_facts[c].stats}
    return held | exact_quantiles(df, [c for c in names if c not in held], list(stats.values()))


def _fit_numeric(df: DataFrame, run: Sequence[CleaningOp], column_facts: Mapping[str, ColumnFacts]) -> list[CleaningOp]:
    usable = [o for o in run if o.column in families(df).numeric]
    open_ops = [o for o in usable if "value" not in o.params]
    medians = _quantiles(df, [o.column for o in open_ops if o.params.get("strategy", "median") == "median"], {"median": 0.5}, column_facts)
    means = [o.column for o in open_ops if o.params.get("strategy") == "mean"]
    mean_row = df.agg(*[F.avg(number(df, c)).alias(str(i)) for i, c in enumerate(means)]).head() if means else []
    values = {c: v[0] for c, v in medians.items()} | dict(zip(means, mean_row))
    out = []
    for o in usable:
        value = o.params.get("value")
        if value is None:
            value = values.get(o.column) if o.params.get("strategy", "median") in ("median", "mean") else 0.0
        if value is not None:
            out.append(replace(o, params={**o.params, "value": repr(float(value))}))
    return out


def _fit_modes(df: DataFrame, run: Sequence[CleaningOp]) -> list[CleaningOp]:
    usable = [o for o in run if o.column in families(df).categorical]
    found = modes(df, [o.column for o in usable if "value" not in o.params])
    out = []
    for o in usable:
        value = o.params.get("value", found.get(o.column))
        if value is not None:
            out.append(replace(o, params={**o.params, "value": value}))
    return out


def _fit_fences(df: DataFrame, run: Sequence[CleaningOp], column_facts: Mapping[str, ColumnFacts]) -> list[CleaningOp]:
    usable = [o for o in run if o.column in families(df).numeric and o.params.get("method", "clip") == "clip"]
    quartiles = _quantiles(df, [o.column for o in usable if "low" not in o.params], {"q25": 0.25, "q75": 0.75}, column_facts)
    out = []
    for o in usable:
        low, high = (o.params["low"], o.params["high"]) if "low" in o.params else iqr_fences(quartiles[o.column])
        if low is not None:
            out.append(replace(o, params={**o.params, "low": repr(float(low)), "high": repr(float(high))}))
    return out


def cleaning_summary(before: DataFrame, result: Cleaned) -> DataFrame:
    """One row of counters: shapes, removed rows and columns, filled nulls, reduction of cells."""
    after = result.data
    had = before.agg(F.count("*").alias("rows_before"))
    has = after.agg(F.count("*").alias("rows_after"))
    cells = F.col("rows_before") * len(before.columns)
    dropped = sum(o.op_type == "remove_column" for o in result.applied)
    return had.select("rows_before", has.scalar().alias("rows_after")).select(
        "rows_before", "rows_after",
        F.lit(len(before.columns)).cast("bigint").alias("columns_before"),
        F.lit(len(after.columns)).cast("bigint").alias("columns_after"),
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.lit(dropped).cast("bigint").alias("columns_removed"),
        F.lit(result.nulls_filled).cast("bigint").alias("nulls_filled"),
        F.lit(len(result.applied)).cast("bigint").alias("operations"),
        F.coalesce(F.try_divide((cells - F.col("rows_after") * len(after.columns)) * 100.0, cells), F.lit(0.0)).alias("reduction_pct"),
    )


def cleaning_advice(summary: DataFrame) -> DataFrame:
    c = F.col
    return fired(summary, [
        Rule("warning", "many_rows_removed", c("rows_removed") > c("rows_before") * 0.2, c("rows_removed")),
        Rule("warning", "many_columns_removed", c("columns_removed") > 5, c("columns_removed")),
        Rule("warning", "many_nulls_filled", c("nulls_filled") > c("rows_before") * 0.1, c("nulls_filled")),
        Rule("suggestion", "review_removed_columns", c("columns_removed") > 0, c("columns_removed")),
        Rule("suggestion", "review_removed_rows", c("rows_removed") > 0, c("rows_removed")),
        Rule("suggestion", "review_filled_nulls", c("nulls_filled") > 0, c("nulls_filled")),
        Rule("suggestion", "large_reduction", c("reduction_pct") > 30, c("reduction_pct")),
        Rule("review", "needs_review", (c("operations") > 5) | (c("rows_removed") > c("rows_before") * 0.2), F.lit(1.0)),
    ])

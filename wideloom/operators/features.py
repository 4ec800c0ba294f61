"""Derived features: ratios, bins, logs, interactions, frequencies and row aggregates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from wideloom.functions.columns import col, families, melt, number
from wideloom.functions.rules import Rule, fired
from wideloom.operators.counts import distinct_counts
from wideloom.operators.encoding import frequency_share
from wideloom.operators.profile import numeric_table
from wideloom.operators.quantiles import exact_quantiles

PER_KIND_COLUMNS = 5
RATIO_PARTNERS = 6
INTERACTION_COLUMNS = 3
BINS = 5
MAX_NEW_RATIO = 0.5
TINY = 1e-8


@dataclass(frozen=True)
class FeatureOp:
    op_type: str
    name: str
    sources: tuple[str, ...]
    params: dict[str, str] = field(default_factory=dict)
    success: bool = False
    error: str = ""

    @property
    def label(self) -> str:
        return f"{self.op_type}: {self.name}"


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    return F.when(F.abs(value) < F.lit(math.inf), value).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    below = F.coalesce(b, F.lit(1.0))
    return finite_or_zero(F.coalesce(a, F.lit(0.0)) / F.when(below == 0, F.lit(TINY)).otherwise(below))


def equal_width_bin(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """Right-closed bin number from 0; -1 for NULL."""
    if low is None or high is None:
        return F.lit(-1)
    if low == high:
        return F.when(value.isNotNull(), F.lit(0)).otherwise(F.lit(-1))
    width = (high - low) / bins
    step = F.ceil((value - F.lit(low)) / F.lit(width)) - 1
    return F.when(value.isNotNull(), F.least(F.greatest(step, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(-1)).cast("int")


def log_feature(value: Column) -> Column:
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def row_aggregate(values: Sequence[Column], how: str) -> Column:
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    if how == "sum":
        return total
    count = sum((v.isNotNull().cast("int") for v in values), F.lit(0)).cast("double")
    mean = F.when(count > 0, total / count)
    if how == "mean":
        return mean
    squares = sum((F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(count > 1, F.sqrt(squares / (count - 1))).otherwise(F.lit(0.0))


def plan_features(df: DataFrame, target: str | None = None, *, max_new_ratio: float | None = MAX_NEW_RATIO,
                  per_kind: int | None = PER_KIND_COLUMNS, partners: int | None = RATIO_PARTNERS, interactions: int | None = INTERACTION_COLUMNS,
                  skip: Sequence[str] = (), skip_types: Sequence[str] = (), left_out: list[FeatureOp] | None = None) -> list[FeatureOp]:
    """Fixed order ratio, bin, log, interaction, frequency, aggregate; then capped by width.

    Each limit is a parameter and None lifts it: columns per kind, columns that ratios pair with, columns
    that interact, and new columns as a share of the old ones.  What the limits cut is added to ``left_out``.
    """
    if left_out is not None:
        every = plan_features(df, target, max_new_ratio=None, per_kind=None, partners=None, interactions=None, skip=skip, skip_types=skip_types)
        kept = plan_features(df, target, max_new_ratio=max_new_ratio, per_kind=per_kind, partners=partners, interactions=interactions, skip=skip, skip_types=skip_types)
        left_out += [o for o in every if (o.op_type, o.name, o.sources) not in {(k.op_type, k.name, k.sources) for k in kept}]
        return kept
    numeric = [c for c in families(df).numeric if c != target]
    text = [c for c in families(df).categorical if c != target]
    ops: list[FeatureOp] = []
    for i, a in enumerate(numeric[:per_kind]):
        ops += [FeatureOp("ratio", f"{a}_to_{b}_ratio", (a, b)) for b in numeric[i + 1:partners]]
    lead = numeric[:per_kind]
    ops += [FeatureOp("binning", f"{c}_binned", (c,), {"bins": str(BINS)}) for c in lead]
    limit = None if max_new_ratio is None else max(5, int(sum(c != target for c in df.columns) * max_new_ratio))
    if limit is None or len(ops) < limit:
        shape = {r["column"]: r for r in numeric_table(df, lead).collect()} if lead else {}
        for c in lead:
            s = shape.get(c)
            if s and s["min"] is not None and s["min"] > 0 and abs(s["skewness"] or 0.0) > 1:
                ops.append(FeatureOp("log_transform", f"{c}_log", (c,)))
        if len(numeric) >= 2:
            ops.append(FeatureOp("polynomial", "polynomial_features", tuple(numeric[:interactions])))
        sizes = distinct_counts(df, text) if text else {}
        ops += [FeatureOp("frequency_encoding", f"{c}_frequency", (c,)) for c in text if sizes[c] > 2]
        if len(numeric) >= 3:
            ops += [FeatureOp("aggregation", f"numeric_{how}", tuple(lead), {"operation": how}) for how in ("sum", "mean")]
    return skip_features(ops[:limit], skip, skip_types)


def skip_features(ops: Sequence[FeatureOp], labels: Sequence[str] = (), types: Sequence[str] = ()) -> list[FeatureOp]:
    """Leave out operations by exact ``"type: name"`` label or by type."""
    return [o for o in ops if o.label not in set(labels) and o.op_type not in set(types)]


def apply_features(df: DataFrame, ops: Sequence[FeatureOp],
                   hooks: Sequence[str | Callable[[DataFrame], DataFrame]] = (),
                   fitted_on: DataFrame | None = None) -> tuple[DataFrame, list[FeatureOp]]:
    """Add all features in one ``select`` (frequency features add a lookup each).

    ``hooks`` are SQL projections such as ``"a / b AS r"`` or functions on the DataFrame.
    """
    numeric = set(families(df).numeric)
    done: list[FeatureOp] = []
    new: dict[str, Column] = {}
    ops = fit_features(fitted_on or df, ops)
    frequency: list[FeatureOp] = []
    for o in ops:
        missing = [s for s in o.sources if s not in df.columns]
        wrong = [s for s in o.sources if s not in numeric] if o.op_type != "frequency_encoding" else []
        if o.op_type in ("polynomial", "aggregation"):
            usable = [s for s in o.sources if s in numeric]
            missing, wrong = [], [] if len(usable) >= (2 if o.op_type == "polynomial" else 1) else list(o.sources)
        else:
            usable = list(o.sources)
        if missing or wrong:
            done.append(replace(o, error=f"not usable: {', '.join(missing or wrong)}"))
            continue
        x = [number(df, s) if s in numeric else col(s) for s in usable]
        if o.op_type == "ratio":
            new[o.name] = ratio(*x)
        elif o.op_type == "binning":
            new[o.name] = _bin_column(x[0], o)
        elif o.op_type == "log_transform":
            new[o.name] = log_feature(x[0])
        elif o.op_type == "polynomial":
            for (i, a), (j, b) in itertools.combinations(enumerate(usable), 2):
                new[f"poly_{a}_{b}"] = finite_or_zero(finite_or_zero(x[i]) * finite_or_zero(x[j]))
        elif o.op_type == "aggregation":
            new[o.name] = row_aggregate(x, o.params.get("operation", "sum"))
        elif o.op_type == "frequency_encoding":
            frequency.append(o)
        else:
            done.append(replace(o, error="unknown operation"))
            continue
        done.append(replace(o, success=True))
    kept = [col(c) for c in df.columns if c not in new]
    out = df.select(*kept, *[v.alias(k) for k, v in new.items()]) if new else df
    for o in frequency:
        out = frequency_share(out, o.sources[0], o.name, fitted_on)
    for hook in hooks:
        out = out.selectExpr("*", hook) if isinstance(hook, str) else out.transform(hook)
    return out, done


def fit_features(df: DataFrame, ops: Sequence[FeatureOp]) -> list[FeatureOp]:
    """Write the numbers binning needs into the operations, so a test split reuses them."""
    numeric = set(families(df).numeric)
    binning = [o for o in ops if o.op_type == "binning" and o.sources[0] in numeric]
    width = [o for o in binning if o.params.get("strategy") != "quantile" and "distinct" not in o.params]
    names = list(dict.fromkeys(o.sources[0] for o in width))
    fitted: dict[int, dict[str, str]] = {}
    if names:
        finite = F.when(F.abs("x") < F.lit(math.inf), F.col("x"))
        rows = melt(df, [[number(df, n)] for n in names], ["x"]).groupBy("ci").agg(
            F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()
        ends = {names[r["ci"]]: r for r in rows}
        sizes = distinct_counts(df, names)
        for o in width:
            r = ends.get(o.sources[0])
            known = {} if r is None or r["lo"] is None else {"low": repr(r["lo"]), "high": repr(r["hi"])}
            fitted[id(o)] = {**known, "distinct": str(sizes[o.sources[0]])}
    for o in binning:
        if o.params.get("strategy") == "quantile" and "edges" not in o.params:
            k = int(o.params.get("bins", BINS))
            edges = exact_quantiles(df, [o.sources[0]], [i / k for i in range(1, k)])[o.sources[0]]
            fitted[id(o)] = {"edges": " ".join(repr(e) for e in sorted({e for e in edges if e is not None}))}
    return [replace(o, params={**o.params, **fitted[id(o)]}) if id(o) in fitted else o for o in ops]


def _bin_column(x: Column, o: FeatureOp) -> Column:
    if o.params.get("strategy") == "quantile":
        edges = [float(e) for e in o.params["edges"].split()]
        code = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
        return F.when(x.isNotNull(), code).otherwise(F.lit(-1))
    wanted, distinct = int(o.params.get("bins", BINS)), int(o.params["distinct"])
    low, high = (float(o.params[k]) if k in o.params else None for k in ("low", "high"))
    return equal_width_bin(x, low, high, wanted if distinct >= wanted else max(2, distinct))


def feature_summary(before: DataFrame, after: DataFrame, ops: Sequence[FeatureOp]) -> DataFrame:
    ok = [o for o in ops if o.success]
    row = (len(before.columns), len(after.columns), len(after.columns) - len(before.columns),
           len(ok), len(ops) - len(ok), len({o.op_type for o in ok}))
    return before.sparkSession.createDataFrame(
        [row], "columns_before bigint, columns_after bigint, features_added bigint, succeeded bigint, "
               "failed bigint, op_types bigint")


def feature_log(df: DataFrame, ops: Sequence[FeatureOp]) -> DataFrame:
    rows = [(i, o.op_type, o.name, list(o.sources), o.success, o.error) for i, o in enumerate(ops)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, op_type string, name string, sources array<string>, success boolean, error string")


def feature_advice(summary: DataFrame) -> DataFrame:
    c = F.col
    return fired(summary, [
        Rule("suggestion", "failed_operations", c("failed") > 0, c("failed")),
        Rule("suggestion", "many_features", c("features_added") > 20, c("features_added")),
        Rule("suggestion", "no_features", c("features_added") == 0, c("features_added")),
        Rule("suggestion", "little_variety", c("op_types") < 3, c("op_types")),
        Rule("review", "needs_review", c("features_added") > 10, c("features_added")),
        Rule("warning", "wide_growth", c("features_added") > c("columns_before") * 0.3, c("features_added")),
    ])

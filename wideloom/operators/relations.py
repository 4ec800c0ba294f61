"""Correlations and mutual information between columns."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wideloom.functions.columns import col, families, label_of, melt, number
from wideloom.operators.counts import distinct_counts
from wideloom.operators.quantiles import exact_quantiles

PAIR_THRESHOLD = 0.8
MAX_SUMS = 64
FEW_CLASSES = 20


def pairwise_r(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(a, b, r)`` with Pearson r over the rows where both sides are present.

    All pairs come from one scan.  Values are centred on their mean first, and columns with a
    single value give NULL.  Narrow sets use plain sums inside generated code; wide sets use
    one matrix product per Arrow batch and sum the small matrices.
    """
    pairs = list(pairs)
    names = list(dict.fromkeys(n for p in pairs for n in p))
    stats = _centres(df, names)
    n_rows = stats.pop("")
    live = [p for p in pairs if all(stats[n][1] is not None and stats[n][1] < stats[n][2] for n in p)]
    full = {n for n in names if stats[n][3] == n_rows}
    centred = {n: number(df, n) - F.lit(stats[n][0] or 0.0) for n in names}
    if not live:
        return _pair_rows(df.limit(0).agg(F.lit(0).alias("z")), pairs, {})
    cost = sum(1 if a in full and b in full else 6 for a, b in live) + 2 * len(names)
    if cost > MAX_SUMS:
        return _pairs_by_matrix(df, centred, pairs, live)
    aggs: list[Column] = []
    keys: dict[tuple[str, str], list[str]] = {}
    for n in names:
        if n in full:
            aggs += [F.sum(centred[n]).alias(f"s_{names.index(n)}"),
                     F.sum(centred[n] * centred[n]).alias(f"q_{names.index(n)}")]
    for p, (a, b) in enumerate(live):
        x, y = centred[a], centred[b]
        aggs.append(F.sum(x * y).alias(f"xy_{p}"))
        if a in full and b in full:
            i, j = names.index(a), names.index(b)
            keys[a, b] = ["", f"s_{i}", f"s_{j}", f"q_{i}", f"q_{j}", f"xy_{p}"]
            continue
        both = x.isNotNull() & y.isNotNull()
        xm, ym = F.when(both, x), F.when(both, y)
        aggs += [F.count(xm).alias(f"n_{p}"), F.sum(xm).alias(f"sx_{p}"), F.sum(ym).alias(f"sy_{p}"),
                 F.sum(xm * xm).alias(f"qx_{p}"), F.sum(ym * ym).alias(f"qy_{p}")]
        keys[a, b] = [f"n_{p}", f"sx_{p}", f"sy_{p}", f"qx_{p}", f"qy_{p}", f"xy_{p}"]
    wide = df.agg(F.count("*").alias("n_all"), *aggs)
    formulas = {
        pair: _r(F.col(k[0] or "n_all"), *[F.col(c) for c in k[1:]]) for pair, k in keys.items()
    }
    return _pair_rows(wide, pairs, formulas)


def _pair_rows(wide: DataFrame, pairs, formulas) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 formulas.get((a, b), F.lit(None)).cast("double").alias("r"))
        for a, b in pairs
    ])
    return wide.select(F.inline(rows))


def _r(n, sx, sy, qx, qy, xy) -> Column:
    vx, vy = qx - sx * sx / n, qy - sy * sy / n
    usable = (n > 1) & (vx > qx * 1e-13) & (vy > qy * 1e-13)
    return F.when(usable, (xy - sx * sy / n) / F.sqrt(vx * vy))


def _centres(df: DataFrame, names: Sequence[str]) -> dict:
    rows = (
        melt(df, [[number(df, n)] for n in names], ["x"]).groupBy("ci")
        .agg(F.avg("x").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"),
             F.count("x").alias("n"), F.count("*").alias("rows"))
        .collect()
    )
    out: dict = {n: (None, None, None, 0) for n in names}
    out[""] = max((r["rows"] for r in rows), default=0)
    out.update({names[r["ci"]]: (r["m"], r["lo"], r["hi"], r["n"]) for r in rows})
    return out


def _pairs_by_matrix(df, centred, pairs, live) -> DataFrame:
    names = list(dict.fromkeys(n for p in live for n in p))
    at = {n: i for i, n in enumerate(names)}
    left = np.array([at[a] for a, _ in live])
    right = np.array([at[b] for _, b in live])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            w = there.astype("float64")
            now = np.stack([w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x])
            total = now if total is None else total + now
        if total is not None:
            n, s, q, xy = total
            yield pa.RecordBatch.from_pydict({
                "p": np.arange(len(left), dtype="int32"), "n": n[left, right], "sx": s[left, right],
                "sy": s[right, left], "qx": q[left, right], "qy": q[right, left], "xy": xy[left, right]})

    sums = ("n", "sx", "sy", "qx", "qy", "xy")
    summed = (
        df.select(*[centred[n].alias(f"c{i}") for i, n in enumerate(names)])
        .mapInArrow(partial, "p int, " + ", ".join(f"{s} double" for s in sums))
        .groupBy("p").agg(*[F.sum(s).alias(s) for s in sums])
        .select(label_of([a for a, _ in live], F.col("p")).alias("a"),
                label_of([b for _, b in live], F.col("p")).alias("b"), _r(*[F.col(s) for s in sums]).alias("r"))
    )
    dead = [p for p in pairs if p not in set(live)]
    if not dead:
        return summed
    return summed.unionByName(df.sparkSession.createDataFrame([(a, b, None) for a, b in dead], "a string, b string, r double"))


def correlated_pairs(df: DataFrame, names: Sequence[str] | None = None, above: float = PAIR_THRESHOLD) -> DataFrame:
    names = list(families(df).numeric if names is None else names)
    return pairwise_r(df, list(itertools.combinations(names, 2))).where(F.abs("r") > above)


def target_correlations(df: DataFrame, target: str, names: Sequence[str] | None = None) -> DataFrame:
    names = [n for n in (families(df).numeric if names is None else names) if n != target]
    return (
        pairwise_r(df, [(n, target) for n in names]).where("r IS NOT NULL")
        .select(F.col("a").alias("column"), F.col("r").alias("correlation"))
    )


def is_classification(df: DataFrame, target: str, task: str | None = None) -> bool:
    """String target or fewer than 20 distinct values, unless ``task`` says otherwise."""
    if task:
        return task == "classification"
    return target in families(df).categorical or distinct_counts(df, [target])[target] < FEW_CLASSES


def mutual_information(df: DataFrame, target: str, names: Sequence[str] | None = None, *, bins: int = 10,
                       task: str | None = None) -> DataFrame:
    """``(column, mi_binned)`` in nats: features cut at their exact deciles, nulls read as 0.

    A regression target is cut the same way.  The joint counts have at most
    features x bins x classes rows.
    """
    names = [n for n in (families(df).numeric if names is None else names) if n != target]
    filled = df.select(*[F.coalesce(number(df, n), F.lit(0.0)).alias(n) for n in names], col(target))
    probs = [i / bins for i in range(1, bins)]
    if is_classification(df, target, task):
        y, cut_names = F.coalesce(col(target).cast("string"), F.lit("missing")), names
        edges = exact_quantiles(filled, cut_names, probs)
    else:
        filled = filled.withColumn(target, number(df, target))
        edges = exact_quantiles(filled, [*names, target], probs)
        y = F.when(col(target).isNotNull(), _bin_of(col(target), edges[target]).cast("string"))
    long = melt(filled, [[_bin_of(col(n), edges[n]), y] for n in names], ["xb", "y"]).where("y IS NOT NULL")
    joint = long.groupBy("ci", "xb", "y").agg(F.count("*").alias("nxy"))
    by_x = joint.groupBy("ci", "xb").agg(F.sum("nxy").alias("nx"))
    by_y = joint.groupBy("ci", "y").agg(F.sum("nxy").alias("ny"))
    total = joint.groupBy("ci").agg(F.sum("nxy").alias("n"))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny")))
    return (
        joint.join(by_x, ["ci", "xb"]).join(by_y, ["ci", "y"]).join(F.broadcast(total), "ci")
        .groupBy("ci").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi_binned"))
        .select(label_of(names, F.col("ci")).alias("column"), "mi_binned")
    )


def _bin_of(value: Column, edges: Sequence[float | None]) -> Column:
    cuts = sorted({e for e in edges if e is not None and math.isfinite(e)})
    return sum((F.when(value > F.lit(e), 1).otherwise(0) for e in cuts), F.lit(0))

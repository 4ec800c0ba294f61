"""Exact quantiles of many columns without gathering a column in one task.

Two scans do for most tables.  The first counts the values by the logarithm of their size, in steps of a
256th of an octave: a mergeable sketch of a few thousand counts per column that needs no bounds beforehand
and tells which step every wanted rank lies in, and how many rows lie before it.  The second gathers the
values of these steps only, equal ones as one row.  Steps with too many rows are cut by histogram rounds
first, until they are small or hold a single value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wideloom.functions.columns import melt, number

BUCKET_ROWS = 2_000_000
BINS = 512
STEPS = 256              # of an octave
LOWEST = 1100 * STEPS    # below the step of the smallest double
FILTER_SPANS = 64


@dataclass
class _Span:
    """Part of a column's value range that holds some of the wanted ranks."""

    low: float
    high: float
    offset: int
    rows: int
    ranks: set[int] = field(default_factory=set)
    log_scale: bool = False


def exact_quantiles(
    df: DataFrame,
    names: Sequence[str],
    probs: Sequence[float],
    *,
    bucket_rows: int = BUCKET_ROWS,
    bins: int = BINS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; NULL and NaN are ignored."""
    names = list(names)
    if not names:
        return {}
    values = [number(df, n) for n in names]
    out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    sizes, first = _steps(df, values, probs)
    found: dict[tuple[int, int], float] = {}
    active: dict[int, list[_Span]] = {}
    settled: dict[int, list[_Span]] = {}

    def place(ci: int, piece: _Span, more: dict[int, list[_Span]]) -> None:
        if piece.low == piece.high:
            found.update({(ci, k): piece.low for k in piece.ranks})
        else:
            (settled if piece.rows <= bucket_rows else more).setdefault(ci, []).append(piece)
    for ci, pieces in first.items():
        for piece in pieces:
            place(ci, piece, active)
    while active:
        counts = _histogram(df, values, active, bins)
        nxt: dict[int, list[_Span]] = {}
        for ci, spans in active.items():
            for index, span in enumerate(spans):
                for piece in _narrow(span, counts.get((ci, index), []), bool(span.log_scale)):
                    place(ci, piece, nxt)
        active = nxt
    if settled:
        found.update(_values_at(df, values, settled))
    for ci, n in sizes.items():
        for j, p in enumerate(probs):
            position = (n - 1) * p
            low, high = found[(ci, math.floor(position))], found[(ci, math.ceil(position))]
            out[names[ci]][j] = low if low == high else low + (high - low) * (position - math.floor(position))
    return out


def _steps(df: DataFrame, values: Sequence[Column], probs: Sequence[float]) -> tuple[dict[int, int], dict[int, list[_Span]]]:
    """Rows per column, and the steps that hold a wanted rank.  Steps are contiguous as the logarithm is monotonic."""
    x, size = F.col("x"), F.abs("x")
    step = F.when(size == 0, 0).when(size == math.inf, 2 ** 30).otherwise(F.floor(F.log2(size) * STEPS) + LOWEST)
    long = melt(df, [[v] for v in values], ["x"]).where("x IS NOT NULL")
    steps = long.groupBy("ci", F.when(x < 0, -step).otherwise(step).cast("int").alias("step")).agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    column = W.partitionBy("ci")   # one row per step
    before = F.coalesce(F.sum("n").over(column.orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = [f((F.col("total") - 1) * F.lit(float(p))).cast("bigint") for p in probs for f in (F.floor, F.ceil)]
    held = (
        steps.withColumns({"total": F.sum("n").over(column), "before": before})
        .withColumn("ranks", F.filter(F.array_distinct(F.array(*place)), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))))
        .where(F.size("ranks") > 0).collect()
    )
    spans: dict[int, list[_Span]] = {}
    for r in sorted(held, key=lambda r: (r["ci"], r["before"])):
        spans.setdefault(r["ci"], []).append(_Span(r["lo"], r["hi"], r["before"], r["n"], set(r["ranks"])))
    return {r["ci"]: r["total"] for r in held}, spans


def _slots(spans: Sequence[_Span], width: int) -> list[Column]:
    """Bounds of a column's spans as literal cells, padded with ranges nothing falls into."""
    cells: list[Column] = []
    for i in range(width):
        low, high, log = (spans[i].low, spans[i].high, spans[i].log_scale) if i < len(spans) else (math.inf, -math.inf, False)
        cells += [F.lit(low), F.lit(high), F.lit(log)]
    return cells


def _spans_long(df: DataFrame, values: Sequence[Column], spans: dict[int, list[_Span]]) -> DataFrame:
    """Rows ``(ci, x, iv, lo, hi, log)`` of the values that lie in one of their column's spans.

    The bounds travel as constants next to each value, so the code that picks a span is
    compiled once and not once per column.
    """
    width = max(len(s) for s in spans.values())
    if sum(len(s) for s in spans.values()) <= FILTER_SPANS:
        df = df.where(reduce(or_, [values[ci].between(s.low, s.high) for ci, ss in spans.items() for s in ss]))
    names = [f"{part}{i}" for i in range(width) for part in ("lo", "hi", "log")]
    long = melt(df, [[values[ci], *_slots(s, width)] for ci, s in spans.items()], ["x", *names]).where("x IS NOT NULL")
    pick = lambda part: _first_match(width, [F.col(f"{part}{i}") for i in range(width)])
    return long.select(
        "ci", "x", _first_match(width, [F.lit(i) for i in range(width)]).alias("iv"),
        pick("lo").alias("lo"), pick("hi").alias("hi"), pick("log").alias("log")).where("iv IS NOT NULL")


def _first_match(width: int, results: Sequence[Column]) -> Column:
    x, found = F.col("x"), None
    for i in range(width):
        inside = (x >= F.col(f"lo{i}")) & (x <= F.col(f"hi{i}"))
        found = F.when(inside, results[i]) if found is None else found.when(inside, results[i])
    return found


def _histogram(df, values, active, bins):
    """Row count, minimum and maximum per span and bin."""
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    scale = lambda v: F.when(F.col("log"), F.signum(v) * F.log1p(F.abs(v))).otherwise(v)
    if any(s.log_scale for spans in active.values() for s in spans):
        share = (scale(x) - scale(lo)) / (scale(hi) - scale(lo))
    else:
        share = (x - lo) / (hi - lo)
    # An overflowing range gives NaN or 0 shares; its two ends still fall into different bins.
    step = F.when(x >= hi, bins - 1).otherwise(F.least(F.greatest(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * bins), F.lit(0)), F.lit(bins - 1)))
    b = F.when(lo >= hi, 0).otherwise(step).cast("int")
    rows = (
        _spans_long(df, values, active)
        .groupBy("ci", "iv", b.alias("b"))
        .agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .collect()
    )
    owners = list(active)
    counts: dict[tuple[int, int], list] = {}
    for r in sorted(rows, key=lambda r: r["b"]):
        counts.setdefault((owners[r["ci"]], r["iv"]), []).append(r)
    return counts


def _narrow(span: _Span, bucket_rows, was_log: bool) -> list[_Span]:
    pieces, below = [], span.offset
    for r in bucket_rows:
        ranks = {k for k in span.ranks if below <= k < below + r["n"]}
        if ranks:
            crowded = r["n"] * 2 > span.rows
            pieces.append(_Span(r["lo"], r["hi"], below, r["n"], ranks, crowded and not was_log))
        below += r["n"]
    return pieces


def _values_at(df, values, settled) -> dict[tuple[int, int], float]:
    """The values at the wanted ranks of small spans, by a running count inside each span."""
    owners = list(settled)
    flat = {f"{i}.{j}": s for i, ci in enumerate(owners) for j, s in enumerate(settled[ci])}
    names = {key: n + 1 for n, key in enumerate(flat)}
    place = F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.concat_ws(".", "ci", "iv"))
    offset = F.element_at(F.array(*[F.lit(s.offset) for s in flat.values()]), place)
    ranks = F.element_at(F.array(*[F.array(*[F.lit(k) for k in sorted(s.ranks)]) for s in flat.values()]), place)
    run = F.sum("n").over(W.partitionBy("ci", "iv").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    hits = (
        _spans_long(df, values, settled)
        .groupBy("ci", "iv", "x").agg(F.count("x").alias("n"))
        .select("ci", "x", "n", (run + offset).alias("upto"), ranks.alias("ranks"))
        .select("ci", "x", F.filter("ranks", lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))).alias("hit"))
        .where(F.size("hit") > 0)
        .collect()
    )
    return {(owners[r["ci"]], k): r["x"] for r in hits for k in r["hit"]}


def iqr_fences(quartiles: Sequence[float | None], factor: float = 1.5) -> tuple[float | None, float | None]:
    """Tukey fences from ``(q25, q75)``."""
    q1, q3 = quartiles
    if q1 is None or q3 is None:
        return None, None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)

"""Column profiles: nulls, moments, quantiles, outliers, categories and memory estimate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from wideloom.functions.columns import Families, col, families, label_of, melt, number
from wideloom.operators.counts import distinct_counts, duplicate_rows, value_counts
from wideloom.operators.quantiles import exact_quantiles, iqr_fences

HIGH_NULL_PCT = 50.0
HIGH_CARDINALITY = 100
IDENTIFIER_RATIO = 0.95
TOP_VALUES = 10
QUARTILES = (0.25, 0.5, 0.75)
NUMERIC_STATS = ("count", "mean", "std", "min", "q25", "median", "q75", "max",
                 "skewness", "kurtosis", "zeros", "outliers")
FIXED_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 8}


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, null_count, null_pct)`` from a single aggregation."""
    names = df.columns
    missing = [F.count("*") - F.count(present(df, n)) for n in names]
    wide = df.agg(F.count("*").alias("n"), *[m.alias(f"c{i}") for i, m in enumerate(missing)])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("null_count"))
                     for i, n in enumerate(names)])
    return wide.select("n", F.inline(rows)).select(
        "column", "null_count",
        F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("n")), F.lit(0.0)).alias("null_pct"),
    )


def overall_nulls(df: DataFrame) -> DataFrame:
    """``(null_cells, cells, null_pct)`` over the whole table."""
    nulls = sum((F.count("*") - F.count(present(df, n)) for n in df.columns), F.lit(0))
    cells = F.count("*") * len(df.columns)
    return df.agg(nulls.alias("null_cells"), cells.alias("cells")).select(
        "null_cells", "cells",
        F.coalesce(F.try_divide(F.col("null_cells") * 100.0, F.col("cells")), F.lit(0.0)).alias("null_pct"),
    )


def top_null_columns(df: DataFrame, k: int = 20) -> DataFrame:
    return null_profile(df).where("null_pct > 0").orderBy(F.desc("null_pct"), "column").limit(k)


def high_null_columns(df: DataFrame, above: float = HIGH_NULL_PCT) -> DataFrame:
    return null_profile(df).where(F.col("null_pct") > above)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL, for counting."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def numeric_table(df: DataFrame, names: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """One row per numeric column with every statistic of ``NUMERIC_STATS``.

    Quartiles come first.  One more scan then computes all moments as power sums around the
    median (stable and cheap to compile) together with the counts outside the fences.
    """
    names = list(families(df).numeric if names is None else names)
    quartiles = approx_quantiles(df, names, QUARTILES) if approx else exact_quantiles(df, names, QUARTILES)
    entries = []
    for n in names:
        q1, mid, q3 = quartiles[n]
        low, high = iqr_fences((q1, q3))
        x = number(df, n)
        outside = F.lit(0) if low is None else F.when((x < low) | (x > high), 1).otherwise(0)
        entries.append([x, F.lit(mid or 0.0), outside])
    d = F.col("x") - F.col("shift")
    sums = (
        melt(df, entries, ["x", "shift", "outside"])
        .groupBy("ci")
        .agg(
            F.count("x").alias("n"), F.first("shift").alias("shift"),
            F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"),
            F.sum(d * d * d * d).alias("s4"), F.min("x").alias("lo"), F.max("x").alias("hi"),
            F.count_if(F.col("x") == 0).alias("zeros"), F.sum("outside").alias("outliers"),
        )
    )
    n = F.col("n").cast("double")
    m = F.try_divide(F.col("s1"), n)
    m2 = F.try_divide(F.col("s2"), n) - m * m
    m3 = F.try_divide(F.col("s3"), n) - 3 * m * F.try_divide(F.col("s2"), n) + 2 * m * m * m
    m4 = (F.try_divide(F.col("s4"), n) - 4 * m * F.try_divide(F.col("s3"), n)
          + 6 * m * m * F.try_divide(F.col("s2"), n) - 3 * m * m * m * m)
    spread = (F.col("lo") < F.col("hi")) & (m2 > 0)
    variance = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.greatest(m2, F.lit(0.0)))
    pick = lambda j: F.element_at(F.array(*[F.lit(quartiles[c][j]).cast("double") for c in names]), F.col("ci") + 1)
    return sums.select(
        label_of(names, F.col("ci")).alias("column"),
        F.col("n").alias("count"),
        (F.col("shift") + m).alias("mean"),
        F.when(n > 1, F.sqrt(variance * n / (n - 1))).alias("std"),
        F.col("lo").alias("min"), pick(0).alias("q25"), pick(1).alias("median"), pick(2).alias("q75"),
        F.col("hi").alias("max"),
        F.when(spread & (n > 2), m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(spread & (n > 3), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)).alias("kurtosis"),
        F.when(n > 0, F.col("zeros")).alias("zeros"),
        F.when(n > 0, F.col("outliers")).alias("outliers"),
    )


def profile_numeric(df: DataFrame, names: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """Long form ``(column, stat, value)``; an all-null column has the single stat ``count``."""
    wide = numeric_table(df, names, approx=approx)
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in NUMERIC_STATS])
    return wide.select("column", F.inline(pairs)).where("value IS NOT NULL")


def approx_quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    names = list(names)
    long = melt(df, [[number(df, n)] for n in names], ["x"]).where("x IS NOT NULL")
    rows = long.groupBy("ci").agg(F.approx_percentile("x", list(probs), 10_000).alias("q")).collect()
    out: dict[str, list] = {n: [None] * len(probs) for n in names}
    out.update({names[r["ci"]]: list(r["q"]) for r in rows})
    return out


def outliers_iqr(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return numeric_table(df, names).select("column", "q25", "q75", F.coalesce("outliers", F.lit(0)).alias("outliers"))


def categorical_profile(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, cardinality ratio, top value, its share and base-2 entropy."""
    names = list(families(df).categorical if names is None else names)
    counts = value_counts(df, names)
    totals = _column_totals(df, names)
    p = F.col("cnt") / F.col("count")
    best = F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v")))
    return (
        counts.join(F.broadcast(totals), "column")
        .groupBy("column", "count")
        .agg(
            F.count("*").alias("unique_values"), best.alias("best"),
            (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"),
        )
        .select(
            "column", "count", "unique_values",
            (F.col("unique_values") / F.col("count")).alias("cardinality"),
            F.col("best.v").alias("top"), (-F.col("best.k")).alias("freq"),
            (-F.col("best.k") * 100.0 / F.col("count")).alias("mode_pct"), "entropy",
        )
    )


def _column_totals(df: DataFrame, names: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.count(col(n)).alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("count")) for i, n in enumerate(names)])
    return wide.select(F.inline(rows))


def top_values(df: DataFrame, names: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """``(column, rank, value, cnt)``; the rank filter is applied before the shuffle too."""
    names = list(families(df).categorical if names is None else names)
    order = W.partitionBy("column").orderBy(F.desc("cnt"), F.asc("value"))
    return (
        value_counts(df, names)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("column", "rank", "value", "cnt")
    )


def distinct_flags(df: DataFrame, names: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """Distinct count per column with the constant / high-cardinality / identifier flags."""
    names = list(df.columns if names is None else names)
    kinds = families(df)
    distinct = distinct_counts(df, names, approx)
    wide = df.agg(F.count("*").alias("n_rows"), *[(F.count("*") - F.count(present(df, c))).alias(f"c{i}")
                                                   for i, c in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds.of(c)).alias("family"),
                 F.lit(distinct[c]).cast("bigint").alias("unique_values"), F.col(f"c{i}").alias("nulls"))
        for i, c in enumerate(names)
    ])
    return wide.select("n_rows", F.inline(rows)).select(
        "column", "unique_values",
        (F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("n_rows")), F.lit(0.0)) > HIGH_NULL_PCT).alias("is_high_null"),
        (F.col("unique_values") <= 1).alias("is_constant"),
        ((F.col("family") == "categorical") & (F.col("unique_values") > HIGH_CARDINALITY)).alias("is_high_cardinality"),
        (F.coalesce(F.try_divide(F.col("unique_values"), F.col("n_rows")), F.lit(0.0)) > IDENTIFIER_RATIO).alias("is_identifier"),
    )


def memory_bytes(df: DataFrame) -> Column:
    """Aggregate for the estimated in-memory size: fixed widths plus the bytes of the strings."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.sum(F.octet_length(col(f.name)).cast("bigint")), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            width = FIXED_WIDTH.get(f.dataType.elementType.simpleString(), 8)
            total = total + F.coalesce(F.sum(F.greatest(F.size(col(f.name)), F.lit(0)).cast("bigint") * width), F.lit(0))
        else:
            total = total + F.count("*") * FIXED_WIDTH.get(f.dataType.simpleString(), 8)
    return total


def memory_estimate(df: DataFrame) -> DataFrame:
    return df.agg(memory_bytes(df).alias("bytes")).select("bytes", (F.col("bytes") / 1048576.0).alias("memory_mb"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per family."""
    kinds = families(df)
    rows = F.array(*[F.lit(kinds.of(c)) for c in df.columns])
    one = df.agg(F.count("*").alias("n_rows"))
    return one.select("n_rows", F.explode(rows).alias("family")).groupBy("family").agg(
        F.count("*").alias("n_columns"), F.max("n_rows").alias("n_rows"))


def column_summary(df: DataFrame, first: int | None = None, digits: int = 1, *, approx: bool = False) -> DataFrame:
    """Type family, non-null count, distinct count and null share per column."""
    names = df.columns[:first] if first else df.columns
    kinds = families(df)
    distinct = distinct_counts(df, names, approx)
    wide = df.agg(F.count("*").alias("n"), *[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kinds.of(c)).alias("family"),
                 F.col(f"c{i}").alias("non_null"), F.lit(distinct[c]).cast("bigint").alias("unique_values"))
        for i, c in enumerate(names)
    ])
    return wide.select("n", F.inline(rows)).select(
        "position", "column", "family", "non_null", "unique_values",
        F.round(F.coalesce(F.try_divide((F.col("n") - F.col("non_null")) * 100.0, F.col("n")), F.lit(0.0)), digits).alias("null_pct"),
    )


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of the table in scan order."""
    return df.limit(rows)


def target_distribution(df: DataFrame, target: str, bins: int = 20, top: int = TOP_VALUES) -> DataFrame:
    """Top value counts of a target with few values, otherwise an equal-width histogram."""
    if distinct_counts(df, [target])[target] < 20 or target not in families(df).numeric:
        return top_values(df, [target], top).select("rank", "value", "cnt")
    x = number(df, target)
    low, high = df.agg(F.min(x), F.max(x)).head()
    width = (high - low) / bins
    bucket = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return (
        df.select(bucket.alias("b")).where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("cnt"))
        .select((F.col("b") + 1).alias("rank"),
                F.concat_ws("..", F.format_string("%.4f", F.lit(low) + F.col("b") * width),
                            F.format_string("%.4f", F.lit(low) + (F.col("b") + 1) * width)).alias("value"), "cnt")
    )


@dataclass(frozen=True)
class ColumnFacts:
    name: str
    family: str
    nulls: int
    distinct: int
    null_pct: float
    stats: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class TableFacts:
    """The driver-side summary decisions are taken from; its size follows the schema width."""

    rows: int
    kinds: Families
    columns: dict[str, ColumnFacts]
    duplicates: int

    @property
    def null_cells(self) -> int:
        return sum(c.nulls for c in self.columns.values())

    @property
    def null_pct(self) -> float:
        cells = self.rows * len(self.columns)
        return 100.0 * self.null_cells / cells if cells else 0.0

    def constants(self) -> list[str]:
        return [c.name for c in self.columns.values() if c.distinct <= 1]

    def identifiers(self) -> list[str]:
        return [c.name for c in self.columns.values() if self.rows and c.distinct / self.rows > IDENTIFIER_RATIO]

    def high_null(self, above: float = HIGH_NULL_PCT) -> list[str]:
        return [c.name for c in self.columns.values() if c.null_pct > above]


def table_facts(df: DataFrame, *, approx: bool = False, duplicates: bool = True, moments: bool = True) -> TableFacts:
    """Profile the table once and keep the numbers the planning rules read."""
    kinds = families(df)
    names = [c for c in df.columns if c not in kinds.skipped]
    row = df.agg(F.count("*").alias("n"), *[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).head()
    distinct = distinct_counts(df, names, approx)
    numeric = {r["column"]: r.asDict() for r in numeric_table(df, approx=approx).collect()} \
        if moments and kinds.numeric else {}
    n = row["n"]
    facts = {}
    for i, c in enumerate(names):
        nulls = n - row[f"c{i}"]
        facts[c] = ColumnFacts(c, kinds.of(c), nulls, distinct[c], 100.0 * nulls / n if n else 0.0, numeric.get(c, {}))
    copies = duplicate_rows(df.select(*[col(c) for c in names])).head()[0] if duplicates and names else 0
    return TableFacts(n, kinds, facts, copies)

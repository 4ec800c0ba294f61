"""Value counts, distinct counts, duplicate rows and skew-proof lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wideloom.functions.columns import col, label_of, melt
from wideloom.session import cut

BROADCAST_BYTES = 64 * 1024 * 1024
ENTRY_BYTES = 64
HOT_SHARE = 1_000
REPEATED_HASHES = 4_000_000  # 64 MB when broadcast


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, value, cnt)`` for all named columns from one scan and one shuffle.

    Rows collapse to distinct values inside each map task, so a value held by a large part
    of the table costs one row per task in the shuffle.
    """
    names = list(names)
    long = melt(df, [[col(n).cast("string")] for n in names], ["value"])
    return (
        long.where("value IS NOT NULL")
        .groupBy("ci", "value").agg(F.count("*").alias("cnt"))
        .select(label_of(names, F.col("ci")).alias("column"), "value", "cnt")
    )


def distinct_counts(df: DataFrame, names: Sequence[str] | None = None, approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column, exact unless ``approx``.

    The columns of a type are melted to (column number, value), so a row of the shuffle is two columns wide.
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))] \
        if names is None else list(names)
    if approx:
        row = df.agg(*[_distinct(df, n, True).alias(str(i)) for i, n in enumerate(names)]).head() if names else {}
        return {n: row[str(i)] for i, n in enumerate(names)}
    out = {n: 0 for n in names}
    by_type: dict[str, list[str]] = {}
    for n in names:
        by_type.setdefault(df.schema[n].dataType.simpleString(), []).append(n)
    for group in by_type.values():
        long = melt(df, [[_countable(df, n)] for n in group], ["value"]).where("value IS NOT NULL")
        rows = long.groupBy("ci", "value").agg(F.lit(1).alias("one")).groupBy("ci").agg(F.count("*").alias("n")).collect()
        out.update({group[r["ci"]]: r["n"] for r in rows})
    return out


def _countable(df: DataFrame, name: str) -> Column:
    value = col(name)
    return F.when(~F.isnan(value), value) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else value


def _distinct(df: DataFrame, name: str, approx: bool) -> Column:
    value = _countable(df, name)
    return F.approx_count_distinct(value, 0.02) if approx else F.count_distinct(value)


def duplicate_rows(df: DataFrame, *, repeated_hashes: int = REPEATED_HASHES) -> DataFrame:
    """One row ``duplicate_rows``: rows that repeat an earlier row on all columns.

    A first shuffle carries only row hashes.  Hashes seen more than once are counted: up to
    ``repeated_hashes`` of them are broadcast and only their rows are compared in full, so a table
    with few copies is never shuffled at full width.  With more, all rows are grouped.
    """
    hashed = df.withColumn("_h", F.xxhash64(*[col(c) for c in df.columns]))
    repeated = cut(hashed.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"))
    few = repeated.count() <= repeated_hashes
    return (
        (hashed.join(F.broadcast(repeated), "_h", "left_semi") if few else df)
        .groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    )


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest one on ties."""
    names = list(names)
    out: dict[str, object] = {n: None for n in names}
    by_type: dict[str, list[str]] = {}
    for n in names:
        by_type.setdefault(df.schema[n].dataType.simpleString(), []).append(n)
    for group in by_type.values():
        long = melt(df, [[col(n)] for n in group], ["value"]).where("value IS NOT NULL")
        rows = (
            long.groupBy("ci", "value").agg(F.count("*").alias("cnt"))
            .groupBy("ci").agg(F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v"))).alias("m"))
            .collect()
        )
        out.update({group[r["ci"]]: r["m"]["v"] for r in rows})
    return out


def lookup(df: DataFrame, key: str, table: DataFrame, counts: str, default: Column, out: str, *,
           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left lookup of ``out`` from ``table(key, out, counts)`` that stays even under skew.

    The table is measured first.  Up to ``broadcast_bytes`` it is broadcast.  A larger one is
    split by its own counts: keys holding more than 1/1000 of the rows (fewer than 1000 keys)
    are broadcast, and what is left has no heavy key when it is joined through a shuffle.
    """
    found = F.coalesce(F.col(out), default).alias(out)
    columns = [col(c) for c in df.columns]
    width = F.octet_length(F.col(key).cast("string")) + ENTRY_BYTES
    size, total = table.agg(F.sum(width.cast("bigint")), F.sum(counts)).head()
    if (size or 0) <= broadcast_bytes:
        joined = df.join(F.broadcast(table.select(key, out)), key, "left")
        return joined.select(*columns, found)
    hot = F.broadcast(table.where(F.col(counts) * HOT_SHARE > total).select(key, out))
    cold = table.where(F.col(counts) * HOT_SHARE <= total).select(key, out)
    keyed = df.where(col(key).isNotNull())
    heavy = keyed.join(hot, key, "inner").select(*columns, found)
    light = keyed.join(hot.select(key), key, "left_anti").join(cold, key, "left").select(*columns, found)
    missing = df.where(col(key).isNull()).select(*columns, default.alias(out))
    return heavy.unionByName(light).unionByName(missing)

"""Categorical columns to numbers, by the number of categories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from wideloom.functions.columns import col, families, label_of, melt
from wideloom.functions.numbers import first_digits, to_number
from wideloom.operators.counts import lookup, value_counts

MISSING = "__MISSING__"
LABEL_LIMIT = 10
HASH_BUCKETS = 10_000


@dataclass(frozen=True)
class Encoder:
    """How one column becomes a number: constant, binary, label, frequency, year, flag, digits, drop."""

    column: str
    kind: str
    codes: dict[str, int] = field(default_factory=dict)
    distinct: int = 0


def non_numeric_text(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(column, bad_values)``: columns holding at least one value that is not a number."""
    names = list(families(df).categorical if names is None else names)
    text = F.col("t")
    return (
        melt(df, [[col(n).cast("string")] for n in names], ["t"])
        .groupBy("ci").agg(F.count_if(text.isNotNull() & to_number(text).isNull()).alias("bad_values"))
        .where("bad_values > 0").select(label_of(names, F.col("ci")).alias("column"), "bad_values")
    )


def with_missing(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def fit_encoders(df: DataFrame, target: str | None = None, names: Sequence[str] | None = None) -> list[Encoder]:
    """Choose an encoder per column from one pass of value counts.

    Only columns with at most ten categories send their values to the driver.
    """
    kinds = families(df)
    text = [c for c in (kinds.categorical if names is None else names) if c != target]
    encoders: list[Encoder] = []
    if text:
        filled = df.select(*[with_missing(col(c)).alias(c) for c in text])
        counts = value_counts(filled, text)
        small = F.collect_list("value")
        sizes = {r["column"]: r["k"] for r in counts.groupBy("column").agg(F.count("*").alias("k")).collect()}
        few = [c for c in text if sizes.get(c, 0) <= LABEL_LIMIT]
        values = {r["column"]: sorted(r["v"]) for r in counts.where(F.col("column").isin(few))
                  .groupBy("column").agg(small.alias("v")).collect()} if few else {}
        for c in text:
            k = sizes.get(c, 0)
            kind = "constant" if k <= 1 else "binary" if k == 2 else "label" if k <= LABEL_LIMIT else "frequency"
            encoders.append(Encoder(c, kind, {v: i for i, v in enumerate(values.get(c, []))}, k))
    if names is None:
        encoders += [Encoder(c, "year") for c in kinds.datetime if c != target]
        encoders += [Encoder(c, "flag") for c in kinds.boolean if c != target]
        encoders += [Encoder(c, "drop") for c in kinds.skipped if c != target]
    return encoders


def apply_encoders(df: DataFrame, encoders: Sequence[Encoder], fitted_on: DataFrame | None = None) -> DataFrame:
    """Replace each column by its code; frequency codes are counts over ``fitted_on``."""
    source = df if fitted_on is None else fitted_on
    by_name = {e.column: e for e in encoders}
    out = []
    for c in df.columns:
        e = by_name.get(c)
        if e is None:
            out.append(col(c))
        elif e.kind != "drop":
            out.append(_code(c, e).alias(c))
    encoded = df.select(*out)
    for e in encoders:
        if e.kind == "frequency":
            encoded = _frequency(encoded, source, e)
    return encoded


def _code(name: str, e: Encoder) -> Column:
    if e.kind == "constant":
        return F.lit(0)
    if e.kind in ("binary", "label"):
        code = F.lit(None).cast("int")
        for value, number in reversed(list(e.codes.items())):
            code = F.when(with_missing(col(name)) == F.lit(value), number).otherwise(code)
        return F.coalesce(code, F.lit(0))
    if e.kind == "frequency":
        return with_missing(col(name))
    if e.kind == "year":
        return F.coalesce(F.year(col(name)), F.lit(0))
    if e.kind == "flag":
        return F.coalesce(col(name).cast("int"), F.lit(0))
    return first_digits(col(name).cast("string"))


def _frequency(df: DataFrame, source: DataFrame, e: Encoder) -> DataFrame:
    table = source.groupBy(with_missing(col(e.column)).alias("_key")).agg(F.count("*").alias("_count"))
    table = table.withColumn("_code", F.col("_count"))
    names = df.columns
    keyed = df.withColumnRenamed(e.column, "_key") if e.column != "_key" else df
    joined = lookup(keyed, "_key", table, "_count", F.lit(0), "_code")
    return joined.select(*[F.col("_code").alias(c) if c == e.column else col(c) for c in names])


def encode_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """Whole table to numbers, target untouched."""
    return apply_encoders(df, fit_encoders(df, target))


def encode_digits(df: DataFrame, name: str, out: str) -> DataFrame:
    return df.withColumn(out, first_digits(col(name).cast("string")))


def encode_hash(df: DataFrame, name: str, out: str) -> DataFrame:
    """Fallback code in [0, 10000) from a stable 64-bit hash of the text."""
    return df.withColumn(out, F.pmod(F.xxhash64(with_missing(col(name))), F.lit(HASH_BUCKETS)).cast("int"))


def frequency_share(df: DataFrame, name: str, out: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """``out`` = share of all rows that hold the row's value; a null value gives 0."""
    source = df if fitted_on is None else fitted_on
    total = source.count()
    table = (
        source.where(col(name).isNotNull()).groupBy(col(name).alias("_key")).agg(F.count("*").alias("_count"))
        .withColumn("_share", F.col("_count") / F.lit(float(max(total, 1))))
    )
    joined = lookup(df.withColumn("_key", col(name)), "_key", table, "_count", F.lit(0.0), "_share")
    return joined.select(*[col(c) for c in df.columns], F.col("_share").alias(out))

"""Column families, quoting and null-safe expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Column by exact name, also when the name has dots, spaces or backticks."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Families:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    datetime: tuple[str, ...]
    boolean: tuple[str, ...]
    skipped: tuple[str, ...]

    def of(self, name: str) -> str:
        for family in ("numeric", "categorical", "datetime", "boolean"):
            if name in getattr(self, family):
                return family
        return "skipped"


def family_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "skipped"


def families(df: DataFrame) -> Families:
    """Split the schema into families; nested and binary columns are reported as skipped."""
    found: dict[str, list[str]] = {}
    for field in df.schema.fields:
        found.setdefault(family_of(field.dataType), []).append(field.name)
    return Families(*(tuple(found.get(f, ())) for f in
                      ("numeric", "categorical", "datetime", "boolean", "skipped")))


def number(df: DataFrame, name: str) -> Column:
    """Numeric column as double with NaN turned into NULL."""
    value = col(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def normalise(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on every float column so that one missing-value rule applies."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns
    ])


def known(names: Sequence[str], df: DataFrame) -> list[str]:
    """Those of ``names`` that exist in ``df``, in the given order."""
    present = set(df.columns)
    return [n for n in names if n in present]


def melt(df: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Long form: one output row per entry, led by the entry number ``ci``.

    Statistics grouped by ``ci`` compile to a small loop whatever the width of the table,
    whereas hundreds of aggregates side by side outgrow what the JVM will compile.
    """
    cells: list[Column] = []
    for index, entry in enumerate(entries):
        cells.append(F.lit(index))
        cells.extend(entry)
    return df.select(F.stack(F.lit(len(entries)), *cells).alias("ci", *names))


def label_of(names: Sequence[str], index: Column) -> Column:
    """Column name for an entry number of :func:`melt`."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def between_or_null(value: Column, low: float, high: float) -> Column:
    """Clip that keeps NULL as NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))

"""Text to number conversions that return NULL for text that is not a number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SYMBOLS = ",$%"
NUMBER_START = r"^\s*[+-]?(?:\.?[0-9]|(?i:inf|nan))"


def to_number(text: Column) -> Column:
    """Double value of a string; Java's ``1d`` / ``1f`` suffixes do not count as numbers."""
    bare = F.rtrim(text)
    suffix = F.right(bare, F.lit(1)).isin("d", "D", "f", "F") & ~F.lower(bare).endswith("inf")
    # The cheap test on the first characters spares the parser most texts; failed parses are slow.
    parsed = F.when(~suffix & text.rlike(NUMBER_START), text).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def strip_symbols(text: Column) -> Column:
    return F.translate(text, SYMBOLS, "")


def first_digits(text: Column) -> Column:
    """First run of digits as a number, 0 when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))

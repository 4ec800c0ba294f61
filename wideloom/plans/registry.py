"""Registry of named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``; ``oracle`` is the same result in plain SQL."""
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class View:
    """A derived input written once and used by both engines."""

    def __init__(self, text: str, *tables: str):
        self.text, self.tables = text, tables

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(self.text, **{t: table(spark, sf_dir, t) for t in self.tables})

    @property
    def sql(self) -> str:
        return self.text.format(**{t: t for t in self.tables})


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round the named columns; summation order differs between engines in the last digits."""
    wanted = set(names)
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


def union_sql(parts) -> str:
    return "\nUNION ALL\n".join(parts)

"""Table scans by file type, with the missing-value and type rules of the data model."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wideloom.functions.columns import col, normalise
from wideloom.sources.workbook import read_workbooks

# Texts that mean "missing" in a delimited file.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORMATS = {".csv": "csv", ".parquet": "parquet", ".xlsx": "workbook"}


def format_of(path: str) -> str:
    """Format by extension; refuses what cannot be read."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type {suffix or '(none)'}: {path}")
    return FORMATS[suffix]


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               **options) -> DataFrame:
    """Read CSV, Parquet or a folder of workbooks; NaN becomes NULL."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        return normalise(spark.read.parquet(path))
    if fmt == "workbook":
        return read_workbooks(spark, path)
    return normalise(read_csv(spark, path, schema, **options))


def csv_traits(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether some quoted cell has a line break.

    UTF-8 unless some line is not valid UTF-8; then Latin-1, which decodes any byte.  A line with an odd
    number of quotes starts or ends a cell that goes over lines.  The text source keeps the raw bytes of a
    line, so this is one splittable scan.
    """
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False)),
                                    F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False))).head()
    return "ISO-8859-1" if row[0] else "UTF-8", row[1]


def csv_encoding(spark: SparkSession, path: str) -> str:
    return csv_traits(spark, path)[0]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, encoding: str | None = None,
             multi_line: bool | None = None, infer: bool = True) -> DataFrame:
    """Headed CSV.  Without a schema every column is typed from all of its values.

    Files are split among tasks unless a cell has a line break, which is found by a scan when ``multi_line`` is None.
    """
    found = csv_traits(spark, path) if encoding is None or multi_line is None else None
    reader = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", found[1] if multi_line is None else multi_line)
        .option("encoding", encoding or found[0])
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    text = raw.select(*[F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in raw.columns])
    return typed(text, infer_types(text)) if infer else text


def infer_types(text: DataFrame) -> dict[str, str]:
    """Type per string column: bigint, double, boolean or string, from one aggregation."""
    aggs = []
    for i, c in enumerate(text.columns):
        v = F.trim(col(c))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()).alias(f"l{i}"),
            F.count_if(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$")).alias(f"d{i}"),
            F.count_if(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    row = text.agg(*aggs).head()
    out = {}
    for i, c in enumerate(text.columns):
        n = row[f"n{i}"]
        out[c] = ("double" if n == 0 else "bigint" if row[f"l{i}"] == n else "double" if row[f"d{i}"] == n
                  else "boolean" if row[f"b{i}"] == n else "string")
    return out


def typed(text: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return text.select(*[
        col(c) if kinds[c] == "string" else F.trim(col(c)).try_cast(kinds[c]).alias(c) for c in text.columns])


def exclude_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the named columns; unknown names are ignored."""
    return df.drop(*[n for n in names if n in df.columns])


def retarget(df: DataFrame, wanted: str | None, current: str | None = None) -> str | None:
    """The wanted target when it exists, otherwise the current one."""
    return wanted if wanted in df.columns else current


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(col(target))

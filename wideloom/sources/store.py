"""Stored tables with a catalogue row, file checksums and table fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from wideloom.functions.columns import col
from wideloom.operators.profile import memory_estimate
from wideloom.operators.runlog import append, log_rows, schema_key
from wideloom.session import cut, ship

PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|lzo)$"   # endings that the text reader unpacks
BATCH_BYTES = 8_000_000
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def store_table(df: DataFrame, base: str, name: str, *, project_id: str, source_agent: str = "store",
                when: datetime | None = None) -> str:
    """Write ``df`` as Parquet and append a catalogue row (path, shape, columns, types)."""
    when = when or datetime.now(timezone.utc).replace(tzinfo=None)
    path = f"{base.rstrip('/')}/tables/{name}/{when:%Y%m%dT%H%M%S%f}"
    df.write.mode("error").parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    payload = {"name": name, "path": path, "rows": rows, "columns": df.columns, "dtypes": dict(df.dtypes), "schema_key": schema_key(df)}
    append(log_rows(df.sparkSession, [{
        "id": f"{project_id}-{name}-{when:%Y%m%dT%H%M%S%f}", "table_name": "stored_tables", "project_id": project_id,
        "source_agent": source_agent, "timestamp": when, "payload": payload}]), f"{base.rstrip('/')}/log")
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalogue(log: DataFrame) -> DataFrame:
    """Stored tables as columns."""
    field = lambda k: F.get_json_object("payload", f"$.{k}")
    return log.where("table_name = 'stored_tables'").select(
        "project_id", "timestamp", field("name").alias("name"), field("path").alias("path"),
        field("rows").cast("bigint").alias("n_rows"), field("schema_key").alias("schema_key"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """MD5 per file, each file in order through one task, which holds a batch of its rows at a time.

    The text reader hands the bytes on between one line feed and the next, so a file may have any size; only a stretch
    without a line feed is held whole.  What it would unpack (by the file's ending) is read whole instead, below 2 GB each.
    """
    files = spark.read.format("binaryFile").load(path)
    name, packed = F.element_at(F.split("path", "/"), -1), F.lower("_metadata.file_name").rlike(PACKED)
    whole = files.where(packed).select(name.alias("file"), "length", F.md5("content").alias("md5"))
    listed = files.where(~packed).select(F.col("_metadata.file_path").alias("at"), name.alias("file"), "length")
    longest = listed.agg(F.max("length")).head()[0] or 0
    if not longest:
        return whole
    rows = spark.read.schema("value string").option("lineSep", "\n").text(path).where(~packed).select(
        F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    ship(spark)
    with _whole_files(spark, longest):   # the parts of a read are made when it runs, so it runs here
        made = cut(rows.mapInArrow(_digests, "at string, md5 string"))
        made.count()
    only_mark = F.when(F.col("length") == len(BYTE_ORDER_MARK), F.md5(F.lit(BYTE_ORDER_MARK)))   # a file without a row
    digest = F.coalesce("md5", only_mark, F.raise_error(F.concat(F.lit("not read: "), "at")).cast("string"))
    return listed.join(made, "at", "left").select("file", "length", digest.alias("md5")).unionByName(whole)


@contextmanager
def _whole_files(spark: SparkSession, longest: int):
    """No file of up to ``longest`` bytes is cut into parts, none shares a part with another, and rows go to Python in small batches."""
    sizes = {"spark.sql.files.maxPartitionBytes": longest, "spark.sql.files.openCostInBytes": longest, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name, None) for name in sizes}
    for name, size in sizes.items():
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(at, md5)`` of files that come as the rows between line feeds, in order.

    The reader drops a byte order mark and does not tell whether a last line feed was there; the size of the file does.
    """
    held = None

    def close() -> pa.RecordBatch:
        at, size, plain, marked, seen = held
        short = size - seen   # with a line feed behind every row
        if short in (0, 3):
            end = b"\n"
        elif short in (-1, 2):
            end = b""
        else:
            raise ValueError(f"{at}: read {seen} bytes of {size}")
        digest = marked if short > 0 else plain
        digest.update(end)
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], ["at", "md5"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ats = batch.column(0)
        runs = pc.run_end_encode(ats)
        lo = 0
        for at, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            lines = batch.column(2).slice(lo, hi - lo).to_pylist()
            if held is None or held[0] != at:
                if held is not None:
                    yield close()
                held = [at, batch.column(1)[lo].as_py(), hashlib.md5(), hashlib.md5(BYTE_ORDER_MARK), 0]
                data = b"\n".join(lines)
            else:
                data = b"\n".join([b"", *lines])
            held[4] += len(data) + (held[4] == 0)   # the line feed behind the last row is counted, and added by the next
            held[2].update(data)
            held[3].update(data)
            lo = hi
    if held is not None:
        yield close()


def table_fingerprint(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(n_rows, fingerprint)`` that does not depend on row order or file layout.

    Sums the first 32 bits of every row's MD5, so repeated rows count as well.  Fields carry their
    length and nulls a mark of their own, so different rows never read alike.
    """
    names = list(df.columns if names is None else names)
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))
    text = F.concat_ws("|", *[field(col(n).cast("string")) for n in names])
    return df.agg(F.count("*").alias("n_rows"),
                  F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def ingest_record(df: DataFrame, path: str = "") -> DataFrame:
    """One-row record of an ingested table: path, shape, types, null counts and size."""
    size = memory_estimate(df).select("memory_mb").scalar()
    counts = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.count("*") - F.count(col(c)))])
    types = F.create_map(*[x for n, t in df.dtypes for x in (F.lit(n), F.lit(t))])
    return df.agg(F.count("*").alias("n_rows"), counts.alias("null_counts")).select(
        F.lit(path).alias("path"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        types.alias("dtypes"), "null_counts", size.alias("memory_mb"))



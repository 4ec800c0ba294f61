"""Shared pieces of the text operators: columns, folds, stored intermediates, words and groups."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wideloom.session import shared_dir, ship

CHUNK_BYTES = 1_000_000  # text handled at once inside a task; a longer single text is its own chunk
BATCH_BYTES = 2_000_000  # rows sent to Python at once, in both processes; a longer single row is its own batch
HASH_TOP = 2.0 ** 63
BROADCAST_IDS = 1_000_000  # ids in a broadcast, about 32 MB; more are joined by a shuffle


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)`` of the input; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(column: Column, parts: int) -> Column:
    """Remainder of crc32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts).cast("bigint"))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write are dropped when it is done; ``free`` drops the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_path(spark)}/{tag}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession) -> str:
    """The session's shared folder; a session on a cluster without one is refused."""
    path = shared_dir(spark)
    if path is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path.rstrip("/")


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[pa.RecordBatch]], schema: str, per_task: bool = False) -> DataFrame:
    """``fn`` gets the columns of an Arrow batch as lists, cut into chunks of bounded text, and yields Arrow batches.

    With ``per_task``, ``fn()`` makes that function once in every task, so what it remembers ends with the task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn() if per_task else fn
        for batch in batches:
            for part in slices(batch):
                yield from each({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
    prepared(df.sparkSession)
    return df.mapInArrow(run, schema)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepared(spark: SparkSession) -> None:
    """Send the package, and bound the Arrow batches of the session by bytes: 10,000 texts at once would be held by the JVM and by Python."""
    ship(spark)
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with a bounded amount of ``text``; only one is turned into Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_pylist()
    for lo, hi in chunks(sizes):
        yield batch.slice(lo, hi - lo)


def chunks(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``limit`` bytes, or one text."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n + 32 > limit:
            yield lo, i
            lo, total = i, 0
        total += n + 32
    if lo < len(sizes):
        yield lo, len(sizes)


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D; with ``lower`` only A-Z is lower-cased (bytes do just that)."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def coded(docs: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Number the words of a chunk: ``(number per word, words per text, distinct words)``."""
    seen: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    put = seen.setdefault
    codes = np.fromiter((put(w, len(seen)) for w in chain.from_iterable(docs)), np.int64, int(lengths.sum()))
    return codes, lengths, list(seen)


def hashes(items: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Order-dependent combination of two arrays of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def kept_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of ``key``; all rows when there are no more."""
    n = df.count()
    if n > limit:
        share = int((min(1.2 * limit / n, 1.0) * 2 - 1) * HASH_TOP)
        df = df.where(F.xxhash64(key) < F.lit(min(share, 2 ** 63 - 1)))
    return df.orderBy(F.xxhash64(key), key).limit(limit)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node reachable over ``edges(a, b)``, for every node of an edge.

    Alternates the large-star and small-star steps of connected components by map and reduce until the
    edges no longer change.  Every step is a grouped minimum and a join; each result is stored.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _state(cur)
    while state[0]:
        both = cur.union(cur.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        nxt = stored(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "cc")
        free(cur)
        was, state = state, _state(nxt)
        cur = nxt
        if was == state:
            break
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def sized(ids: DataFrame) -> DataFrame:
    """A table of ids, ready to be joined: broadcast if it is counted and no larger than ``BROADCAST_IDS``."""
    ids = stored(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in the one column of ``ids``; null ids stay."""
    name = "_" + uuid.uuid4().hex   # no column of the input has this name
    gone = sized(ids.toDF(name))
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[name], "left_anti")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, ...)`` whose ``doc_id`` is in the one column of ``ids``."""
    return docs.join(sized(ids.toDF("doc_id")), "doc_id", "left_semi")


def letters_present(column: Column) -> Column:
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")

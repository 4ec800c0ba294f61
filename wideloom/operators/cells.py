"""Exact nearest neighbours by cells: most rows are never compared.

Base rows are dealt to the nearest of some centres; a cell keeps its radius.  Every query first looks into one block
of the cells nearest to it, which bounds the distance of its k-th best.  Then it visits only those cells that the
triangle inequality leaves possible: centre distance less radius no more than that bound.  Centres come from a few
rounds of k-means on a sample of at most ``SAMPLE`` rows; a bad sample costs time, never a neighbour.

Cells of many rows are cut into blocks by a hash of the id, so a crowded cell does not land in one task.  Queries with
the same nearest cell are packed into blocks, and blocks of the base into shelves.  Every block of queries meets the
shelves of the first look, then those with a cell that one of its queries may need: both are read from the shared
folder, a task keeps the k best so far, and no pair is stored.  What is written is the vectors a few times, as floats
if they come so, also on data without clusters, where every cell is possible.
Cosine works on vectors of length one, whose distance orders alike.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wideloom.session import cut, ship

SAMPLE = 20_000
MOST_CENTRES = 4096
ROUNDS = 6
BLOCK_ROWS = 20_000       # rows of a block
SLACK = 1e-5              # distances from rounded scores
QUERY_ROWS = 2000         # queries of a block
SHELF_ROWS = 4000         # base rows of small cells that are kept together
SHARE_BYTES = 64_000_000  # base vectors that a task holds
PAIRS_SENT = 8            # pairs of a block of queries and a shelf sent to Python at once
TASKS = 3                 # parts of the queries for each core
BOUND_BYTES = 64_000_000  # bounds of the queries that are broadcast


def centres(sample: np.ndarray, count: int) -> np.ndarray:
    """A few rounds of k-means, started from rows spread over the sample."""
    found = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(ROUNDS):
        near = distances(sample, found).argmin(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=count)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0))


def _vectors(column: pa.Array, unit: bool) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None] if unit else x


def nearest_by_cells(q: DataFrame, b: DataFrame, k: int, unit: bool, score: Callable, schema: str, *, exclude_self: bool,
                     n_base: int, block_rows: int = BLOCK_ROWS, count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(candidates, visits)`` of ``q(_q, _v)`` against ``b(_b, _v)``.

    ``score(queries, least)`` keeps the k best of the blocks added to it for a block of queries, and gives them as
    ``schema``; candidates hold the k best of all rows.  ``visits(_q, cell, block)`` says what was looked into.
    """
    spark = q.sparkSession
    ship(spark)
    if unit:   # vectors without a direction have no cosine
        q, b = (d.where(F.exists("_v", lambda v: v != 0)) for d in (q, b))
    share = min(1.0, 1.2 * SAMPLE / max(n_base, 1))
    picked = b.where(F.pmod(F.xxhash64("_b"), F.lit(1_000_003)) <= int(share * 1_000_003)).select("_v").limit(SAMPLE).collect()
    if not picked:
        picked = b.select("_v").limit(SAMPLE).collect()
    if not picked:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "_q bigint, cell int, block int")
    sample = np.array([r["_v"] for r in picked], np.float64)
    sample = sample / np.sqrt((sample * sample).sum(1))[:, None] if unit else sample
    count = min(count or max(1, n_base // block_rows, math.isqrt(n_base) // 8), MOST_CENTRES, len(sample))
    shared = spark.sparkContext.broadcast(centres(sample, count))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_vectors(batch.column(1), unit), shared.value)
                cell = d.argmin(1)
                yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("far", pa.array(d[np.arange(len(d)), cell]))
    kind = {n: d.schema[n].dataType.simpleString() for d, n in ((q, "_q"), (b, "_b"), (b, "_v"))}
    q = q.withColumn("_v", F.col("_v").cast(kind["_v"])) if q.schema["_v"].dataType != b.schema["_v"].dataType else q
    dealt = cut(b.mapInArrow(deal, f"_b {kind['_b']}, _v {kind['_v']}, cell int, far double"))
    facts = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()   # one row per centre
    rows, radius = np.zeros(count, np.int64), np.full(count, -np.inf)
    for r in facts:
        rows[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    blocks = np.maximum(1, -(-rows // block_rows))
    first_shelf = np.array(_shelves(rows, blocks))
    shelf = spark.createDataFrame([(i, int(n), int(s)) for i, (n, s) in enumerate(zip(blocks, first_shelf))], "cell int, blocks int, shelf int")   # at most MOST_CENTRES rows
    block = F.pmod(F.xxhash64("_b", F.lit(1)), F.col("blocks")).cast("int")
    shelved = dealt.join(F.broadcast(shelf), "cell").select("_b", "_v", "cell", (F.col("shelf") + block).alias("shelf"))
    held = cut(shelved.groupBy("shelf").applyInArrow(_pack_shelf, "shelf int, held array<int>, kept binary"))
    held = held.coalesce(max(1, math.ceil(n_base * sample.shape[1] * 8 / SHARE_BYTES))).hint("shuffle_replicate_nl")
    need = k + (1 if exclude_self else 0)

    def housed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                yield batch.append_column("home", pa.array(distances(_vectors(batch.column(1), unit), shared.value).argmin(1).astype(np.int32)))

    def looks(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Every query with the cells nearest to it, from the nearest on, until enough rows are likely to be seen in one block of each."""
        d = distances(_vectors(vectors, unit), shared.value)
        d[:, rows == 0] = np.inf
        order = d.argsort(1, kind="stable")
        seen = np.minimum(rows // blocks // 2 + (blocks == 1) * (rows - rows // 2), rows)[order]
        at, nth = np.nonzero((np.cumsum(seen, 1) - seen < need) & (rows[order] > 0))
        return at, order[at, nth]

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(lo, QUERY_ROWS)
                near = np.unique(np.concatenate([looks(batch.column(1).slice(i, 1000))[1] for i in range(0, batch.num_rows, 1000)]))
                picked = _picked(batch.column(0)[0].as_py(), near, blocks)
                yield pa.RecordBatch.from_arrays([pa.array([np.unique(first_shelf[near] + picked).tolist()], pa.list_(pa.int32())),
                                                  pa.array([_packed(pa.Table.from_batches([batch]).drop(["home"]))], pa.binary())], ["first", "asked"])
    parts = TASKS * spark.sparkContext.defaultParallelism
    packed = q.mapInArrow(housed, f"_q {kind['_q']}, _v {kind['_v']}, home int").repartitionByRange(parts, "home", F.xxhash64("_q")) \
        .sortWithinPartitions("home").mapInArrow(pack_queries, "first array<int>, asked binary")
    asked = cut(packed.withColumn("of", F.monotonically_increasing_id())).coalesce(parts)

    def compare(batches: Iterator[pa.RecordBatch], take: Callable, wanted: Callable) -> Iterator[pa.RecordBatch]:
        """The best rows of all shelves of a partition for the block of queries that comes with them; ``take`` says what is sent of them."""
        last, merged, of = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if last != batch.column("of")[i].as_py():
                    if merged is not None:
                        yield take(of, merged)
                    last = of = batch.column("of")[i].as_py()
                    # a copy, as the buffer of the batch would keep all of it
                    left = _unpacked(pa.py_buffer(batch.column("asked")[i].as_buffer().to_pybytes()))
                    least = batch.column("least")[i].as_buffer() if batch.column("least")[i].is_valid else None
                    merged = score(left, np.full(left.num_rows, -np.inf) if least is None else np.frombuffer(least.to_pybytes()))
                merged.add(wanted(batch, i, _unpacked(batch.column("kept")[i].as_buffer())))
        if merged is not None:
            yield take(of, merged)

    def glance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the k best rows of the first shelves."""
        def scores(of, merged):
            best = merged.best[0] if merged.best is not None else np.full((len(merged.keys), k), -np.inf)
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([best.tobytes()], pa.binary())], ["of", "scores"])
        yield from compare(batches, scores, lambda batch, i, right: right)

    def kth(group: pa.Table) -> pa.Table:
        """The k-th best score of every query of a block, as far as seen."""
        scores = np.concatenate([np.frombuffer(s).reshape(-1, k) for s in group.column("scores").to_pylist()], 1)
        return pa.table({"of": group.column("of")[:1], "least": pa.array([np.sort(scores, 1)[:, -k].tobytes()], pa.binary())})
    # Both sides are read again for every pair of their partitions; nothing of a pair is written or shuffled.
    seen = asked.join(held, F.array_contains("first", F.col("shelf"))).select("of", "asked", F.lit(None).cast("binary").alias("least"), "kept")
    with _small_batches(spark):
        bounds = cut(seen.mapInArrow(glance, "of bigint, scores binary").groupBy("of").applyInArrow(kth, "of bigint, least binary"))
    small = bounds.agg(F.sum(F.length("least"))).head()[0] or 0
    bounded = asked.join(F.broadcast(bounds) if small <= BOUND_BYTES else bounds, "of", "left").select("of", "asked", "least")

    def open_cells(asked: pa.Scalar, least: pa.Scalar) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Parts of a block of queries, and which cells may hold a row within the distance of their k-th best."""
        left = _unpacked(asked.as_buffer())
        score_k = np.frombuffer(least.as_buffer().to_pybytes()) if least.is_valid else np.full(left.num_rows, -np.inf)
        limit = np.sqrt(np.maximum(0.0, (2 - 2 * score_k) if unit else -score_k)) + SLACK
        for lo in range(0, left.num_rows, 1000):
            part = left.slice(lo, 1000)
            d = distances(_vectors(part.column("_v").combine_chunks(), unit), shared.value)
            yield part, (d - radius[None, :] <= limit[lo:lo + 1000, None]) & (rows > 0)[None, :]

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.logical_or.reduce([c.any(0) for _, c in open_cells(batch.column(1)[i], batch.column(2)[i])]) for i in range(batch.num_rows)]
            yield batch.append_column("cells", pa.array([np.flatnonzero(c).tolist() for c in cells], pa.list_(pa.int32())))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # the block of queries glances at the same block of a cell
                name = _unpacked(batch.column(1)[i].as_buffer()).column("_q")[0].as_py()
                for part, may in open_cells(batch.column(1)[i], batch.column(2)[i]):
                    at, cell = np.nonzero(may)
                    each = blocks[cell]
                    block = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    near, home = looks(part.column("_v").combine_chunks())
                    other = ~may[near, home]
                    near, home = near[other], home[other]
                    at, cell, block = np.concatenate([np.repeat(at, each), near]), np.concatenate([np.repeat(cell, each), home]), np.concatenate([block, _picked(name, home, blocks)])
                    yield pa.RecordBatch.from_arrays([part.column("_q").combine_chunks().take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))],
                                                     ["_q", "cell", "block"])
    visits = bounded.mapInArrow(listed, f"_q {kind['_q']}, cell int, block int")
    opened = bounded.mapInArrow(possible, "of bigint, asked binary, least binary, cells array<int>")
    pairs = opened.join(held, F.arrays_overlap("cells", "held")).select("of", "asked", "least", "kept", "cells")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_cells(batch, i, right):
            wanted = np.isin(right.column("cell").to_numpy(), batch.column("cells")[i].values.to_numpy())
            return right if wanted.all() else right.filter(pa.array(wanted))
        yield from compare(batches, lambda _, merged: merged.rows(), of_cells)
    with _small_batches(spark):
        return cut(pairs.mapInArrow(search, schema)), visits


def _picked(name: int | str, cells: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of every cell that the block of queries starting with this one glances at."""
    return (zlib.crc32(str(name).encode()) + cells) % blocks[cells]


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _pack_shelf(group: pa.Table) -> pa.Table:
    rows = group.select(["_b", "_v", "cell"]).combine_chunks()
    return pa.table({"shelf": group.column("shelf")[:1], "held": pa.array([np.unique(rows.column("cell").to_numpy()).tolist()], pa.list_(pa.int32())), "kept": pa.array([_packed(rows)], pa.binary())})


def _shelves(rows: np.ndarray, blocks: np.ndarray) -> list[int]:
    """First shelf of every cell: a block of a cut cell has a shelf of its own, small cells share one."""
    first, at, filled = [], 0, 0
    for n, pieces in zip(rows.tolist(), blocks.tolist()):
        if filled and (pieces > 1 or filled + n > SHELF_ROWS):
            at, filled = at + 1, 0
        first.append(at)
        at, filled = (at + pieces, 0) if pieces > 1 else (at, filled + n)
    return first


@contextmanager
def _small_batches(spark) -> Iterator[None]:
    """Rows of packed blocks are sent to Python a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, PAIRS_SENT)
    try:
        yield
    finally:
        spark.conf.set(name, before)

"""Exact nearest neighbours: top-k by cosine, k-NN vote, tag filters."""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wideloom.operators.cells import BLOCK_ROWS, nearest_by_cells

TOP_K = 5
NEIGHBOURS = 5
SLAB_CELLS = 4_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
ROUGH = 1e-9      # scores are rounded only if they come this near to the k-th best


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector has no length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm)


def search(df: DataFrame, query: Sequence[float], k: int = TOP_K, *, key: str = "id", vector: str = "embedding",
           where: Column | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """Top-k by cosine against one vector.

    ``where`` filters before the search.  ``tags`` keeps entries sharing any tag and is applied
    to the k best, so fewer than k rows can come back.  The plan is a scan and a top-k, no join.
    """
    base = df if where is None else df.where(where)
    target = F.array(*[F.lit(float(v)) for v in query])
    best = base.withColumn("score", cosine(F.col(vector), target)).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)
    if tags:
        best = best.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return best


def nearest(queries: DataFrame, base: DataFrame, k: int, *, query_key: str = "query_id", base_key: str = "id",
            vector: str = "embedding", metric: str = "cosine", exclude_self: bool = False,
            block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(query_id, id, score, rank)``: the exact k best base rows of every query row.

    No pair table is built.  A task holds one block of queries and one block of base rows,
    scores them with a matrix product and emits only its k best per query; a second step ranks
    those few candidates.  Query sets measured below ``broadcast_bytes`` are sent to the base
    partitions, so the base is not shuffled.  Larger ones search the cells of the base that can hold a neighbour.
    Only vectors of equal length are compared.
    Scores: cosine similarity, or negative squared distance for ``metric="euclidean"``.
    """
    floats = all(d.schema[vector].dataType.simpleString() == "array<float>" for d in (queries, base))
    kind = "array<float>" if floats else "array<double>"   # as narrow as they come where they are stored; scores are doubles
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("_q"), F.col(vector).cast(kind).alias("_v"))
    b = base.where(F.col(vector).isNotNull()).select(F.col(base_key).alias("_b"), F.col(vector).cast(kind).alias("_v"))
    widths = [r["w"] for r in q.select(F.size("_v").alias("w")).distinct().orderBy("w").collect()]   # few: vectors have fixed widths
    if len(widths) > 1:
        same = lambda df, w: df.where(F.size(vector) == w)
        parts = [nearest(same(queries, w), same(base, w), k, query_key=query_key, base_key=base_key, vector=vector, metric=metric,
                         exclude_self=exclude_self, block_rows=block_rows, broadcast_bytes=broadcast_bytes) for w in widths]
        return reduce(DataFrame.unionByName, parts)
    b = b.where(F.size("_v") == (widths[0] if widths else 0))
    n_queries, longest = q.agg(F.count("*"), F.max(F.size("_v"))).head()
    schema = f"_q {q.schema['_q'].dataType.simpleString()}, _b {b.schema['_b'].dataType.simpleString()}, score double"
    if n_queries == 0:
        return queries.sparkSession.createDataFrame([], schema).select(
            F.col("_q").alias(query_key), F.col("_b").alias(base_key), "score", F.lit(0).alias("rank"))
    if n_queries * (longest or 0) * 8 <= broadcast_bytes:
        found = _against_broadcast(q, b, k, metric, exclude_self, schema)
    else:
        score = block_score(k, metric, exclude_self, schema)
        found, _ = nearest_by_cells(q, b, k, metric == "cosine", score, schema, exclude_self=exclude_self, n_base=b.count(), block_rows=block_rows)
    order = W.partitionBy("_q").orderBy(F.desc("score"), "_b")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(F.col("_q").alias(query_key), F.col("_b").alias(base_key), "score", "rank")
    )


def _against_broadcast(q, b, k, metric, exclude_self, schema):
    rows = q.collect()
    shared = q.sparkSession.sparkContext.broadcast(
        (np.array([r["_q"] for r in rows]), np.array([r["_v"] for r in rows], dtype="float64")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vectors = shared.value
        best = None
        for batch in batches:
            if batch.num_rows:
                ids, x = np.asarray(batch.column(0).to_pylist()), _matrix(batch.column(1))
                now = _best(keys, vectors, ids, x, k, metric, exclude_self)
                best = now if best is None else _merge(best, now, k)
        if best is not None:
            yield _candidates(keys, best, schema)

    return b.mapInArrow(score, schema)


def block_score(k: int, metric: str, exclude_self: bool, schema: str):
    """What keeps the k best rows of several blocks for a block of queries."""
    return lambda left, least: Running(left, least, k, metric, exclude_self, schema)


class Running:
    """The k best rows so far of a block of queries ``(_q, _v)``; rows that score below ``least`` are passed over."""

    def __init__(self, left: pa.Table, least: np.ndarray, k: int, metric: str, exclude_self: bool, schema: str):
        self.keys, self.x = np.asarray(left.column("_q").to_pylist()), self._ready(_matrix(left.column("_v")), metric)
        size = 1 + np.where(np.isinf(least), 0, np.abs(least)) + (self.x * self.x).sum(1)
        self.least = least - ROUGH * size   # that score was of another product
        self.k, self.metric, self.exclude_self, self.schema = k, metric, exclude_self, schema
        self.best = None

    @staticmethod
    def _ready(x: np.ndarray, metric: str) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1))[:, None] if metric == "cosine" else x

    def add(self, right: pa.Table) -> None:
        if not right.num_rows:
            return
        ids, y = np.asarray(right.column("_b").to_pylist()), self._ready(_matrix(right.column("_v")), self.metric)
        if self.best is None:
            self.best = np.full((len(self.keys), self.k), -np.inf), np.full((len(self.keys), self.k), ids[0])
        elif self.best[1].dtype != ids.dtype:   # texts of other lengths
            self.best = self.best[0], self.best[1].astype(np.result_type(self.best[1], ids))
        square = (y * y).sum(1)
        step = max(1, SLAB_CELLS // len(ids))
        for lo in range(0, len(self.keys), step):
            x, least = self.x[lo:lo + step], self.least[lo:lo + step]
            score = x @ y.T
            if self.metric != "cosine":
                score = 2 * score - (x * x).sum(1)[:, None] - square[None, :]
            at, place = np.nonzero(score >= (least - ROUGH)[:, None])
            score = np.round(score[at, place], 12)   # the same vector scores the same in every block
            live = score >= least[at]
            if self.exclude_self:
                live &= self.keys[lo + at] != ids[place]
            if live.any():
                self._merge(lo + at[live], ids[place[live]], score[live])

    def _merge(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(at)]])))
        rows, of = at[starts], np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(at)]])))
        keep = nth < self.k
        now = np.full((len(rows), self.k), -np.inf), np.full((len(rows), self.k), ids[0], dtype=self.best[1].dtype)
        now[0][of[keep], nth[keep]], now[1][of[keep], nth[keep]] = score[keep], ids[keep]
        found = _merge((self.best[0][rows], self.best[1][rows]), now, self.k)
        self.best[0][rows], self.best[1][rows] = found
        self.least[rows] = np.maximum(self.least[rows], found[0][:, -1])

    def rows(self) -> pa.RecordBatch:
        return _candidates(self.keys, self.best, self.schema)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _best(keys, x, ids, y, k, metric, exclude_self):
    """Best k for every query, scoring a bounded slab of queries at a time."""
    step = max(1, SLAB_CELLS // max(len(ids), 1))
    parts = [_best_slab(keys[i:i + step], x[i:i + step], ids, y, k, metric, exclude_self)
             for i in range(0, len(keys), step)]
    return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])


def _best_slab(keys, x, ids, y, k, metric, exclude_self):
    if metric == "cosine":
        norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(norm > 0, (x @ y.T) / norm, -np.inf)
    else:
        score = 2 * (x @ y.T) - (x * x).sum(1)[:, None] - (y * y).sum(1)[None, :]
    score = np.round(score, 12)  # the same vector scores the same in every block
    if exclude_self:
        score[keys[:, None] == ids[None, :]] = -np.inf
    return _top(score, np.broadcast_to(ids, score.shape), k)


def _top(score, ids, k):
    """The k highest per row; equal scores go to the smaller id."""
    if score.shape[1] > k:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        width = int((score >= kth[:, None]).sum(1).max())
        near = np.argpartition(-score, min(width, score.shape[1]) - 1, axis=1)[:, :width] if width < score.shape[1] else None
        if near is not None:
            score, ids = np.take_along_axis(score, near, 1), np.take_along_axis(ids, near, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _merge(a, b, k):
    return _top(np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]]), k)


def _candidates(keys, best, schema, table=False):
    fields = [f.split(" ") for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    if best is None:
        columns = [[], [], []]
    else:
        score, ids = best
        live = score > -np.inf
        columns = [np.repeat(keys, score.shape[1])[live.ravel()], ids[live], score[live]]
    arrays = [pa.array(np.asarray(c).tolist(), type=types[t]) for c, (_, t) in zip(columns, fields)]
    maker = pa.Table if table else pa.RecordBatch
    return maker.from_arrays(arrays, names=[n for n, _ in fields])


def knn_vote(queries: DataFrame, train: DataFrame, label: str, k: int = NEIGHBOURS, *, query_key: str = "query_id",
             base_key: str = "id", vector: str = "embedding", exclude_self: bool = False, **sizes: int) -> DataFrame:
    """``(query_id, prediction, votes)``: majority label of the k nearest, smallest label on ties."""
    near = nearest(queries, train, k, query_key=query_key, base_key=base_key, vector=vector, metric="euclidean",
                   exclude_self=exclude_self, **sizes)
    labels = train.select(F.col(base_key), F.col(label).alias("_label"))
    votes = near.join(labels, base_key).groupBy(query_key, "_label").agg(F.count("*").alias("votes"))
    return votes.groupBy(query_key).agg(
        F.min(F.struct((-F.col("votes")).alias("k"), F.col("_label").alias("v"))).alias("m")
    ).select(query_key, F.col("m.v").alias("prediction"), (-F.col("m.k")).alias("votes"))

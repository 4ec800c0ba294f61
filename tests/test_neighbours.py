"""Cells: exact neighbours, and most cells are not visited."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wideloom.operators import cells, similarity
from wideloom.session import shared_dir


def best(x, y, k, metric, exclude):
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            s = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
    else:
        s = -((x[:, None] - y[None]) ** 2).sum(2)
    s = np.where(np.isnan(s), -np.inf, np.round(s, 9))
    if exclude:
        np.fill_diagonal(s, -np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(y)), -s[i]))[:k] if s[i, j] > -np.inf] for i in range(len(x)) if (s[i] > -np.inf).any()}


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def frames(spark, x, y):
    make = lambda v, name: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], f"{name} bigint, embedding array<double>")
    return make(x, "query_id"), make(y, "id")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("rows", [12, 60])
def test_cells_are_exact(spark, metric, rows):
    rng = np.random.default_rng(rows)
    y = np.round(rng.normal(size=(240, 3)) + 6 * rng.integers(0, 4, (240, 1)), 2)
    y[30:110] = y[30]          # a third of all rows are copies
    y[5] = 0
    q, b = frames(spark, y, y)
    got = found(similarity.nearest(q, b, 4, metric=metric, exclude_self=True, broadcast_bytes=0, block_rows=rows))
    assert got == best(y, y, 4, metric, True)


def test_fewer_rows_than_wanted_and_no_rows(spark):
    x, y = np.eye(3), np.array([[1.0, 0.1, 0.0], [0.0, 0.0, 0.0]])
    q, b = frames(spark, x, y)
    assert found(similarity.nearest(q, b, 5, broadcast_bytes=0)) == {0: [0], 1: [0], 2: [0]}
    assert similarity.nearest(q, b.limit(0), 5, broadcast_bytes=0).count() == 0
    odd = b.union(spark.createDataFrame([(9, None), (10, [1.0])], b.schema))
    assert found(similarity.nearest(q, odd, 5, broadcast_bytes=0)) == {0: [0], 1: [0], 2: [0]}


def test_most_cells_are_not_visited(spark):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(40, 8)) * 20
    y = middle[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.3
    x = middle[rng.integers(0, 40, 300)] + rng.normal(size=(300, 8)) * 0.3
    q, b = (d.withColumnsRenamed({"query_id": "_q", "id": "_b", "embedding": "_v"}) for d in frames(spark, x, y))
    schema = "_q bigint, _b bigint, score double"
    score = similarity.block_score(5, "euclidean", False, schema)
    got, visits = cells.nearest_by_cells(q, b, 5, False, score, schema, exclude_self=False, n_base=4000, count=60)
    top = {r["_q"]: {r["_b"]} for r in got.groupBy("_q").agg(F.max_by("_b", "score").alias("_b")).collect()}
    assert all(top[i] == {j[0]} for i, j in best(x, y, 1, "euclidean", False).items())
    assert visits.count() < 300 * 60 / 8
    assert visits.distinct().count() == visits.count()


def test_candidates_do_not_grow_with_the_cells(spark):
    """Without clusters every cell is possible; still a query keeps k rows, not k for every block that it is compared with."""
    y = np.random.default_rng(3).normal(size=(1500, 16))
    q, b = (d.withColumnsRenamed({"query_id": "_q", "id": "_b", "embedding": "_v"}) for d in frames(spark, y, y))
    schema = "_q bigint, _b bigint, score double"
    got, visits = cells.nearest_by_cells(q, b, 5, True, similarity.block_score(5, "cosine", True, schema), schema, exclude_self=True, n_base=1500, block_rows=20)
    assert visits.count() > 1500 * 60      # nearly every block of every cell
    assert got.count() == 1500 * 5
    top = {}
    for r in sorted(got.collect(), key=lambda r: (r["_q"], -r["score"], r["_b"])):
        top.setdefault(r["_q"], []).append(r["_b"])
    assert top == best(y, y, 5, "cosine", True)


def test_votes_through_cells_write_no_pairs(spark):
    """The same for distances: vectors and candidates are the only tables written."""
    y = np.round(np.random.default_rng(4).normal(size=(1200, 12)), 3)
    q, b = (d.withColumnsRenamed({"query_id": "_q", "id": "_b", "embedding": "_v"}) for d in frames(spark, y, y))
    schema = "_q bigint, _b bigint, score double"
    got, _ = cells.nearest_by_cells(q, b, 5, False, similarity.block_score(5, "euclidean", True, schema), schema, exclude_self=True, n_base=1200, block_rows=20)
    assert got.count() == 1200 * 5
    q, b = frames(spark, y, y)
    b = b.withColumn("label", F.col("id") % 3)
    few = similarity.knn_vote(q, b, "label", exclude_self=True, broadcast_bytes=0, block_rows=20)
    assert sorted(few.collect()) == sorted(similarity.knn_vote(q, b, "label", exclude_self=True).collect())


def test_vectors_are_stored_as_narrow_as_they_come(spark):
    """Floats stay floats in the shared folder, and a query is stored once, not once for every cell that it glances at."""
    y = np.random.default_rng(5).normal(size=(3000, 64)).astype("float32")
    q, b = (d.withColumn("_v", F.col("_v").cast("array<float>")) for d in (d.withColumnsRenamed({"query_id": "_q", "id": "_b", "embedding": "_v"}) for d in frames(spark, y, y)))
    schema = "_q bigint, _b bigint, score double"
    stored = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("part-*"))
    before = stored()
    got, _ = cells.nearest_by_cells(q, b, 5, False, similarity.block_score(5, "euclidean", True, schema), schema, exclude_self=True, n_base=3000, block_rows=200)
    assert got.count() == 3000 * 5
    assert 3 * y.nbytes < stored() - before < 6 * y.nbytes

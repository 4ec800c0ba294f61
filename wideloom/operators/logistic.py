"""Binary logistic regressions side by side: all folds and penalties of a grid in the same passes over the rows.

Newton's method, with halved steps where one goes too far, on the summed loss plus half the penalty times the squared
coefficients; the intercept bears none.  A pass adds up loss, slopes and second derivatives of all fits that are not
done.  The fits on all rows come first, about ten passes; those that leave out a fold start from them and need two or
three.  Columns are brought to mean 0 and deviation 1 inside, with the penalty on the coefficients as they are; a
constant column gets the coefficient 0, as in MLlib.  Rows are kept packed, one binary per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wideloom.session import ship

MOST_FEATURES = 64    # second derivatives of a fit are a square of this
PASSES = 100
CLOSE = 1e-10         # what the next step may still win, as a part of the loss


def packed(rows: DataFrame, width: int) -> DataFrame:
    """``(label, fold, x)`` of many rows as one binary; read more than once, so persist it."""
    ship(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                table = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), x]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["rows"])
    return rows.select(F.col("label").cast("double"), F.col("fold").cast("int"), "x").mapInArrow(pack, "rows binary")


def _tables(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column(0):
            yield np.frombuffer(data.as_buffer()).reshape(-1, width + 2)


class _Fit:
    """One regression: the best coefficients so far, the step from there, and how much of it is tried next."""

    def __init__(self, penalty: np.ndarray, start: np.ndarray):
        self.penalty, self.at, self.value, self.done = penalty, start, np.inf, False
        self.step, self.share = np.zeros(len(start)), 1.0

    def trial(self) -> np.ndarray:
        return self.at - self.share * self.step

    def seen(self, loss: float, slope: np.ndarray, second: np.ndarray) -> None:
        at = self.trial()
        value = loss + (self.penalty * at * at).sum() / 2
        if not value <= self.value + 1e-12 * abs(self.value):
            self.share /= 2
            self.done = self.share < 1e-9
            return
        self.at, self.value, self.share = at, value, 1.0
        slope = slope + self.penalty * at
        self.step = np.linalg.lstsq(second + np.diag(self.penalty), slope, rcond=None)[0]
        if slope @ self.step <= CLOSE * abs(value):
            self.at, self.done = self.trial(), True


def fit_folds(rows: DataFrame, blocks: DataFrame, width: int, folds: int, penalties: Sequence[float]) -> np.ndarray:
    """``(folds, penalties, width + 1)``: coefficients and intercept of the fits on ``rows(label, fold, x)``, also ``packed``, without a fold."""
    column = [F.get("x", F.lit(i)) for i in range(width)]
    facts = rows.agg(*[f(c) for c in column for f in (F.avg, F.stddev_pop)]).head()
    mean, spread = np.array(facts[::2], np.float64), np.array(facts[1::2], np.float64)
    constant = ~(spread > 0)
    scale = np.where(constant, 1.0, spread)
    on = [np.append(np.where(constant, 1.0, p / scale ** 2), 0.0) for p in penalties]
    column_scale = np.where(constant, np.inf, scale)
    whole = [(-1, _Fit(p, np.zeros(width + 1))) for p in on]
    _run(whole, blocks, width, mean, column_scale)
    fits = [(f, _Fit(p, w.at)) for f in range(folds) for p, (_, w) in zip(on, whole)]
    _run(fits, blocks, width, mean, column_scale)
    found = np.array([fit.at for _, fit in fits])
    coefficients = np.where(constant, 0.0, found[:, :-1] / scale)
    return np.column_stack([coefficients, found[:, -1] - coefficients @ mean]).reshape(folds, len(penalties), width + 1)


def margins(blocks: DataFrame, width: int, fold: int, found: np.ndarray) -> DataFrame:
    """``(label, s0, s1, ...)`` of the rows of a fold: what each of ``found`` says of them."""
    names = [f"s{i}" for i in range(len(found))]

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches, width):
            mine = table[table[:, 1] == fold]
            said = mine[:, 2:] @ found[:, :-1].T + found[:, -1]
            yield pa.RecordBatch.from_arrays([pa.array(mine[:, 0]), *map(pa.array, said.T)], ["label", *names])
    return blocks.mapInArrow(say, ", ".join(f"{n} double" for n in ["label", *names]))


def _run(fits: list[tuple[int, _Fit]], blocks: DataFrame, width: int, mean: np.ndarray, scale: np.ndarray) -> None:
    for _ in range(PASSES):
        live = [(i, f, fit.trial()) for i, (f, fit) in enumerate(fits) if not fit.done]
        if not live:
            break
        for i, (loss, slope, second) in _sums(blocks, live, width, mean, scale).items():
            fits[i][1].seen(loss, slope, second)


def _sums(blocks: DataFrame, live: list[tuple[int, int, np.ndarray]], width: int, mean: np.ndarray, scale: np.ndarray) -> dict[int, tuple]:
    """Loss, slopes and second derivatives of every live fit over the rows outside its fold."""
    held_out, at = np.array([f for _, f, _ in live], np.float64), np.stack([b for _, _, b in live], 1)
    size = width + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, second = np.zeros(len(live)), np.zeros((len(live), size)), np.zeros((len(live), size, size))
        for table in _tables(batches, width):
            y, fold, x = table[:, :1], table[:, 1:2], np.ones((len(table), size))
            x[:, :-1] = (table[:, 2:] - mean) / scale
            inside = (fold != held_out).astype(np.float64)
            margin = x @ at
            tail = np.exp(-np.abs(margin))
            loss += ((np.maximum(margin, 0) - y * margin + np.log1p(tail)) * inside).sum(0)
            share = 1 / (1 + tail)
            p = 0.5 + np.copysign(0.5 - tail * share, margin)
            slope += ((p - y) * inside).T @ x
            bend = (tail * share * share * inside).T
            for i in range(size):   # the upper half, all fits in one product
                second[:, i, i:] += bend @ (x[:, i:i + 1] * x[:, i:])
        second = np.triu(second) + np.triu(second, 1).transpose(0, 2, 1)
        sums = [np.concatenate([[a], b, c.ravel()]).tobytes() for a, b, c in zip(loss, slope, second)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(live)), pa.int32()), pa.array(sums, pa.binary())], ["fit", "sums"])

    def total(group: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(b) for b in group.column("sums").to_pylist())
        return pa.table({"fit": group.column("fit")[:1], "sums": pa.array([summed.tobytes()], pa.binary())})
    out = {}
    for r in blocks.mapInArrow(add, "fit int, sums binary").groupBy("fit").applyInArrow(total, "fit int, sums binary").collect():
        v = np.frombuffer(r["sums"])
        out[live[r["fit"]][0]] = float(v[0]), v[1:size + 1], v[size + 1:].reshape(size, size)
    return out

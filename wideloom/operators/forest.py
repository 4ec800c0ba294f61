"""Random forests without a limit of depth, grown in two phases.

Nodes with many rows are split by histograms over all rows: one pass per level, and only counts by (node, feature,
bin) are shuffled.  Once a node's rows fit a task, they are shipped there by (tree, node), and the task grows the
rest of the tree exactly, level by level over sorted columns.  A table that fits a task skips the first phase, and so
does one whose different rows do: rows of equal features and class are one row there, with their summed weights.

Every row's weight in every tree is a Poisson number drawn from a hash of its key, and the features tried at a node
follow from a hash of its path, so a forest depends on the rows alone, not on how they are spread.  Nodes split while
they are mixed, hold ``min_split`` rows and some tried feature varies; constant features are not counted as tried.
Rows are shipped packed: one binary per node and ``BUFFER_ROWS`` input rows.
A finished forest is a table of subtrees.  Scoring broadcasts a small one; the rows to score go to the subtrees of a
larger one, as training rows do, and the votes come back by blocks of rows and are summed in the order of the trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F

from wideloom.session import cut, ship

KEY, LABEL, FEATURES = "row_key", "label", "features"
TASK_ROWS = 100_000          # rows of a node that one task finishes
BINS = 128
PIECE_BYTES = 64_000_000     # subtrees that are broadcast for scoring
BUFFER_ROWS = 100_000        # input rows that a task looks at together
TABLE_BYTES = 64_000_000     # counts of one histogram pass in a task
KINDS_SHARE = 0.25           # different rows, of all and of a task's, up to which equal ones are sent as one
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)   # odd multipliers


@dataclass(frozen=True)
class Spec:
    """``features`` is the number tried at a node: ``sqrt``, ``all`` or a number."""

    trees: int = 100
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: str | int = "sqrt"
    seed: int = 42
    task_rows: int = TASK_ROWS
    bins: int = BINS

    def tried(self, width: int) -> int:
        if self.features == "sqrt":
            return max(1, math.isqrt(width))
        return width if self.features == "all" else min(int(self.features), width)


def mix(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Hash of two 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = np.asarray(h, np.uint64) * np.uint64(MIX[0]) + np.asarray(salt).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
        return x ^ (x >> np.uint64(31))


def weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often every row is drawn for a tree."""
    return drawn_by(mix(keys.view(np.uint64), seed), tree)


def drawn_by(hashed: np.ndarray, tree: int) -> np.ndarray:
    """``weights`` by the hashes of keys and seed, which are the same for all trees."""
    share = (mix(hashed, tree + 1) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(POISSON, share, "right")


def tried_features(seeds: np.ndarray, varying: np.ndarray, count: int) -> np.ndarray:
    """Per node the first ``count`` varying features in the order of their hashes."""
    if count >= varying.shape[1]:
        return varying
    order = mix(seeds[:, None], np.arange(varying.shape[1])[None, :] + 7).astype(np.float64)
    order[~varying] = np.inf
    rank = order.argsort(1, kind="stable").argsort(1, kind="stable")
    return varying & (rank < count)


def quality(sums: np.ndarray, classify: bool) -> np.ndarray:
    """What a node contributes to the purity of a split; ``sums`` are class weights, or weight and weighted label."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classify:
            return (sums * sums).sum(-1) / sums.sum(-1)
        return sums[..., 1] * sums[..., 1] / sums[..., 0]


def sums_of(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    if not classes:
        return np.stack([w, w * y], 1)
    out = np.zeros((len(y), classes))
    out[np.arange(len(y)), y.astype(np.int64)] = w
    return out


def outcome(sums: np.ndarray, classify: bool) -> np.ndarray:
    """Class shares, or the mean."""
    return sums / sums.sum(-1, keepdims=True) if classify else sums[..., 1:] / sums[..., :1]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, spec: Spec, seed: int, depth: int = 0) -> dict[str, np.ndarray]:
    """The exact tree over these rows, in arrays: feature (-1 at leaves), threshold, left, right, value, importance."""
    n, width = x.shape
    sums, classify, tried = sums_of(y, w, classes), classes > 0, spec.tried(width)
    parts = [np.ascontiguousarray(s) for s in sums.T]
    columns = [np.ascontiguousarray(x[:, f]) for f in range(width)]
    order = [np.argsort(c, kind="stable") for c in columns]   # by node, then by value
    seeds, count, right = np.array([seed], np.uint64), np.array([n]), np.zeros(n, bool)
    feature, threshold, left, value = [], [], [], []
    importance, made = np.zeros(width), 1
    while len(count):
        k = len(count)
        first = np.cumsum(count) - count
        node = np.repeat(np.arange(k), count)
        total = np.stack([np.add.reduceat(p[order[0]], first) for p in parts], 1)
        value.append(outcome(total, classify))
        labels = y[order[0]]
        mixed = np.minimum.reduceat(labels, first) < np.maximum.reduceat(labels, first)
        mixed &= (count >= spec.min_split) & (spec.max_depth is None or depth < spec.max_depth)
        varying = np.stack([c[o[first]] < c[o[first + count - 1]] for c, o in zip(columns, order)], 1) & mixed[:, None]
        cand = tried_features(seeds, varying, tried)
        best, at, where, ends = np.full(k, -np.inf), np.full(k, -1), np.zeros(k), np.zeros(k, np.int64)
        for f in np.flatnonzero(cand.any(0)):
            mine = cand[:, f]
            if mine.all():
                rows, of = order[f], node
            else:
                looked = np.flatnonzero(np.repeat(mine, count))
                rows, of = order[f][looked], node[looked]
            score, cuts, lows, of = _best_cuts(columns[f][rows], of, [p[rows] for p in parts], total, count, mine, classify, spec.min_leaf)
            better = score > best[of]
            of = of[better]
            best[of], at[of], where[of], ends[of] = score[better], f, cuts[better], lows[better]
        split = np.flatnonzero(at >= 0)
        parents = quality(total[split], classify)
        np.add.at(importance, at[split], best[split] - parents)
        kids = made + 2 * np.arange(len(split))
        feats, cuts, lefts = np.full(k, -1), np.zeros(k), np.full(k, -1)
        feats[split], cuts[split], lefts[split] = at[split], where[split], kids
        feature.append(feats)
        threshold.append(cuts)
        left.append(lefts)
        for f in np.unique(at[split]):   # the rows beyond the cut of their node go to the right
            rows = np.flatnonzero(np.repeat(at == f, count))
            right[order[f][rows]] = rows >= np.repeat((first + ends)[at == f], count[at == f])
        if len(split) < k:
            stays = np.flatnonzero(np.repeat(at >= 0, count))
            order = [o[stays] for o in order]
        # Rows keep their order inside a kid: the place of one follows from the rows to the right before it.
        size, low = count[split], ends[split]
        before = np.cumsum(size - low) - (size - low)
        to_left = np.arange(int(size.sum())) + np.repeat(before, size)
        to_right = np.repeat(np.cumsum(size) - size + low - 1 - before, size)
        for f in range(width):
            goes = right[order[f]]
            rights = np.cumsum(goes)
            moved = np.empty_like(order[f])
            moved[np.where(goes, to_right + rights, to_left - rights)] = order[f]
            order[f] = moved
        count = np.stack([low, size - low], 1).ravel()
        seeds = np.stack([mix(seeds[split], 1), mix(seeds[split], 2)], 1).ravel()
        made, depth = made + len(count), depth + 1
    lefts = np.concatenate(left)
    return {"feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "left": lefts,
            "right": np.where(lefts >= 0, lefts + 1, -1), "value": np.concatenate(value).ravel(), "importance": importance}


def _purity(parts: list[np.ndarray], classify: bool) -> np.ndarray:
    """``quality`` of sums that come as one array for each."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if not classify:
            return parts[1] * parts[1] / parts[0]
        squares, whole = parts[0] * parts[0], parts[0]
        for p in parts[1:]:
            squares, whole = squares + p * p, whole + p
        return squares / whole


def _best_cuts(v, g, parts, total, count, mine, classify, min_leaf):
    """Best cut of one feature for every node of ``mine``: ``(score, threshold, rows to the left, node)``; rows come sorted by node and value."""
    first = np.zeros(len(count), np.int64)
    first[mine] = np.cumsum(count[mine]) - count[mine]
    edge = np.flatnonzero((v[:-1] < v[1:]) & (g[:-1] == g[1:]))
    if min_leaf > 1:
        inside = edge - first[g[edge]] + 1
        edge = edge[(inside >= min_leaf) & (count[g[edge]] - inside >= min_leaf)]
    if not len(edge):
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = g[edge]
    low = []
    for p in parts:
        run = np.concatenate([[0.0], np.cumsum(p)])
        low.append(run[edge + 1] - run[first][of])
    score = _purity(low, classify) + _purity([total[of, i] - p for i, p in enumerate(low)], classify)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    top = np.maximum.reduceat(score, starts)
    hit = np.flatnonzero(score == np.repeat(top, np.diff(np.concatenate([starts, [len(of)]]))))
    hit = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])]
    e, nodes = edge[hit], of[hit]
    middle = v[e] + (v[e + 1] - v[e]) / 2
    return score[hit], np.where(middle < v[e + 1], middle, v[e]), e + 1 - first[nodes], nodes


def walk(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Index of the leaf of every row."""
    at = np.zeros(len(x), np.int64)
    live = np.flatnonzero(tree["feature"][at] >= 0)
    while len(live):
        here = at[live]
        f = tree["feature"][here]
        at[live] = np.where(x[live, f] <= tree["threshold"][here], tree["left"][here], tree["right"][here])
        live = live[tree["feature"][at[live]] >= 0]
    return at


class Top:
    """Upper part of one tree.  Its leaves are closed (with a value) or open, to be finished as a part of its own."""

    def __init__(self, seed: int):
        self.feature, self.threshold, self.left, self.right = [-1], [0.0], [-1], [-1]
        self.seed, self.depth, self.value, self.gain = [seed], [0], [None], []

    def split(self, at: int, feature: int, threshold: float, gain: float) -> tuple[int, int]:
        kids = len(self.feature), len(self.feature) + 1
        self.feature[at], self.threshold[at], (self.left[at], self.right[at]) = feature, threshold, kids
        self.gain.append((feature, gain))
        seeds = mix(np.array([self.seed[at]] * 2, np.uint64), np.array([1, 2]))
        for s in seeds:
            for held, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, None)):
                held.append(v)
            self.seed.append(int(s))
            self.depth.append(self.depth[at] + 1)
        return kids

    def arrays(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature), "threshold": np.array(self.threshold), "left": np.array(self.left), "right": np.array(self.right)}


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _ready(df: DataFrame, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.xxhash64(KEY).alias("k"), F.col(LABEL).cast("double").alias("y"), w.alias("w"), vector_to_array(FEATURES).alias("x"))


def fit(train: DataFrame, classes: int, width: int, spec: Spec, weight: str | None = None) -> ForestModel:
    """A forest over ``train(row_key, label, features)``; ``classes`` is 0 for a regression.  A table without rows is refused."""
    spark = train.sparkSession
    ship(spark)
    rows = _ready(train, weight)
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("x", "y"))).head()
    if not n:
        raise ValueError("a forest needs rows")
    tops = [Top(int(mix(np.array([spec.seed], np.uint64), t + 1)[0])) for t in range(spec.trees)]
    # Numbers of rows are looked at for larger limits only; the sums of a regression would depend on the order.
    if classes and n > spec.task_rows and kinds <= KINDS_SHARE * min(n, spec.task_rows) and spec.min_split <= 2 and spec.min_leaf <= 1:
        return ForestModel(spark, tops, cut(_finished(_kinds(rows, width, spec), tops, classes, width, spec)), classes, width, spec)
    if n > spec.task_rows:
        rows = cut(rows)
        _grow_tops(rows, tops, classes, width, spec)
    return ForestModel(spark, tops, cut(_parts(rows, tops, classes, width, spec)), classes, width, spec)


def _grow_tops(rows: DataFrame, tops: list[Top], classes: int, width: int, spec: Spec) -> None:
    """Split nodes of more than ``task_rows`` rows, a level at a time, until none is left."""
    shares = [i / spec.bins for i in range(1, spec.bins)]
    edges = [np.unique(e) for e in rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), shares, 1000).alias(f"e{f}") for f in range(width)]).head()]
    active = [(t, 0) for t in range(len(tops))]
    each = width * (spec.bins + 1) * 8 * (max(classes, 2) + 1)
    batch = max(1, TABLE_BYTES // each)
    while active:
        later = []
        for lo in range(0, len(active), batch):
            later += _split_level(rows, tops, active[lo:lo + batch], edges, classes, width, spec)
        active = later


def _split_level(rows, tops, active, edges, classes, width, spec) -> list[tuple[int, int]]:
    trees = {t: tops[t].arrays() for t, _ in active}
    slot = {t: np.full(len(tops[t].feature), -1) for t in trees}
    for i, (t, node) in enumerate(active):
        slot[t][node] = i
    bins, parts, seed = spec.bins + 1, max(classes, 2) + 1, spec.seed

    ranges: dict[int, list[int]] = {}
    for i, (t, _) in enumerate(active):   # the nodes of a tree are neighbours
        ranges.setdefault(t, [i, i])[1] = i + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(active), width, bins, parts))
        low, high = np.full((len(active), width + 1), np.inf), np.full((len(active), width + 1), -np.inf)
        for keys, y, own, x in _buffers(batches, width):
            columns = [*np.ascontiguousarray(x.T), y]
            cell = [np.searchsorted(e, c, "left") for e, c in zip(edges, columns)]
            shuffled = mix(keys.view(np.uint64), seed)
            for t, tree in trees.items():
                first, end = ranges[t]
                drawn = drawn_by(shuffled, t)
                live = np.flatnonzero(drawn)
                s = slot[t][walk(tree, x[live])]
                live, s = live[s >= 0], s[s >= 0] - first
                if not len(live):
                    continue
                w, label, n = drawn[live] * own[live], y[live], end - first
                for f in range(width):
                    place = s * bins + cell[f][live]
                    here = table[first:end, f]
                    here[..., 0] += np.bincount(place, minlength=n * bins).reshape(n, bins)
                    if classes:
                        here[..., 1:1 + classes] += np.bincount(place * classes + label.astype(np.int64), w, n * bins * classes).reshape(n, bins, classes)
                    else:
                        here[..., 1] += np.bincount(place, w, n * bins).reshape(n, bins)
                        here[..., 2] += np.bincount(place, w * label, n * bins).reshape(n, bins)
                order = np.argsort(s.astype(np.int16) if n < 30_000 else s, kind="stable")
                s = s[order]
                starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                at, placed = first + s[starts], live[order]
                for f, column in enumerate(columns):
                    mine = column[placed]
                    low[at, f] = np.minimum(low[at, f], np.minimum.reduceat(mine, starts))
                    high[at, f] = np.maximum(high[at, f], np.maximum.reduceat(mine, starts))
        for i in np.flatnonzero(low[:, 0] < np.inf):
            yield pa.RecordBatch.from_arrays([
                pa.array([i] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([h.tobytes() for h in table[i]], pa.binary()),
                *[pa.array(v) for v in (low[i, :width], high[i, :width], [low[i, width]] * width, [high[i, width]] * width)]],
                ["node", "f", "table", "low", "high", "least", "most"])

    def best(group: pa.Table) -> pa.Table:
        """Sum the counts of one node and feature and find the best border between bins."""
        table = sum(np.frombuffer(t).reshape(bins, parts) for t in group.column("table").to_pylist())
        f = group.column("f")[0].as_py()
        stats = table[:, 1:1 + classes] if classes else table[:, 1:3]
        low, rows_low = np.cumsum(stats, 0)[:-1], np.cumsum(table[:, 0])[:-1]
        total, n = stats.sum(0), table[:, 0].sum()
        ok = (rows_low >= spec.min_leaf) & (n - rows_low >= spec.min_leaf) & (np.arange(bins - 1) < len(edges[f]))
        score = np.where(ok, quality(low, classes > 0) + quality(total - low, classes > 0), -np.inf)
        at = int(score.argmax())
        ends = [group.column(c).to_numpy() for c in ("low", "high", "least", "most")]
        return pa.table({"node": group.column("node")[:1], "f": group.column("f")[:1], "score": [score[at]], "cut": [edges[f][at] if ok[at] else 0.0],
                         "rows": [n], "rows_low": [rows_low[at] if ok[at] else -1.0], "total": [total.tolist()],
                         "low": [ends[0].min()], "high": [ends[1].max()], "mixed": [bool(ends[2].min() < ends[3].max())]})

    counted = rows.mapInArrow(count, "node int, f int, table binary, low double, high double, least double, most double")
    found: dict[int, dict[int, dict]] = {}
    for r in counted.groupBy("node", "f").applyInArrow(best, "node int, f int, score double, cut double, rows double, rows_low double, total array<double>, "
                                                             "low double, high double, mixed boolean").collect():
        found.setdefault(r["node"], {})[r["f"]] = r.asDict()
    later = []
    for i, (t, node) in enumerate(active):
        top, facts = tops[t], found.get(i)
        if facts is None:   # no row was drawn for this tree, or a halved range is empty on one side
            top.value[node] = []
            continue
        one = facts[0]
        total = np.array(one["total"])
        limit = spec.max_depth is not None and top.depth[node] >= spec.max_depth
        varying = np.array([[facts[f]["low"] < facts[f]["high"] for f in range(width)]])
        if not one["mixed"] or limit or one["rows"] < spec.min_split or not varying.any():
            top.value[node] = outcome(total, classes > 0).tolist()
            continue
        if one["rows"] <= spec.task_rows:
            continue
        tried = np.flatnonzero(tried_features(np.array([top.seed[node]], np.uint64), varying, spec.tried(width))[0])
        pick = max(tried, key=lambda f: (facts[f]["score"], -f))
        fact = facts[pick]
        if fact["score"] == -np.inf:   # all rows lie in one bin of every tried feature: halve the range of the first
            pick = tried[0]
            kids = top.split(node, int(pick), (facts[pick]["low"] + facts[pick]["high"]) / 2, 0.0)
            later += [(t, kid) for kid in kids]
            continue
        kids = top.split(node, int(pick), fact["cut"], fact["score"] - float(quality(total, classes > 0)))
        later += [(t, kid) for kid, m in zip(kids, (fact["rows_low"], fact["rows"] - fact["rows_low"])) if m > spec.task_rows]
    return later


def _parts(rows: DataFrame, tops: list[Top], classes: int, width: int, spec: Spec) -> DataFrame:
    """Ship the rows of every open node to one task and finish its subtree there."""
    trees = [top.arrays() for top in tops]
    open_ = [np.array([v is None and f < 0 for v, f in zip(top.value, top.feature)]) for top in tops]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, y, own, x in _buffers(batches, width):
            shuffled = mix(keys.view(np.uint64), spec.seed)
            for t, tree in enumerate(trees):
                if not open_[t].any():
                    continue
                drawn = drawn_by(shuffled, t)
                live = np.flatnonzero(drawn)
                leaf = walk(tree, x[live])
                live, leaf = live[open_[t][leaf]], leaf[open_[t][leaf]]
                if len(live):
                    nodes, rows_of = _by_node(leaf)
                    packs = [np.concatenate([y[r], drawn[r] * own[r], x[r].T.ravel()]).tobytes() for r in (live[o] for o in rows_of)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t, np.int32)), pa.array(nodes.astype(np.int32)), pa.array(packs, pa.binary())], ["tree", "part", "rows"])

    return _finished(rows.mapInArrow(send, "tree int, part int, rows binary"), tops, classes, width, spec)


def _finished(shipped: DataFrame, tops: list[Top], classes: int, width: int, spec: Spec) -> DataFrame:
    """The subtrees of ``shipped(tree, part, rows)``, a task for each."""
    seeds = {(t, i): (top.seed[i], top.depth[i]) for t, top in enumerate(tops) for i, (v, f) in enumerate(zip(top.value, top.feature)) if v is None and f < 0}

    def finish(group: pa.Table) -> pa.Table:
        t, part = group.column("tree")[0].as_py(), group.column("part")[0].as_py()
        y, w, *x = np.concatenate([np.frombuffer(r).reshape(width + 2, -1) for r in group.column("rows").to_pylist()], 1)
        seed, depth = seeds[t, part]
        made = grow(np.stack(x, 1), y, w, classes, spec, seed, depth)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind)) for v, kind in zip(made.values(), _KINDS)]
        return pa.table([pa.array([t], pa.int32()), pa.array([part], pa.int32()), *lists], names=["tree", "part", *made])
    spread = 3 * shipped.sparkSession.sparkContext.defaultParallelism   # packed rows are small for the work they bring, so tasks do not go by bytes
    return shipped.repartition(spread, "tree", "part").groupBy("tree", "part").applyInArrow(finish, PART_SCHEMA)


def _kinds(rows: DataFrame, width: int, spec: Spec) -> DataFrame:
    """Rows of equal features and label as one, with their summed weight in every tree: ``(tree, part, rows)`` for whole trees."""
    trees = spec.trees

    def summed(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Kinds (label and features) and their weights, as many as a table of ``TABLE_BYTES`` holds at once."""
        held, n, most = [], 0, max(1, TABLE_BYTES // (8 * (trees + width + 1)))
        for block in blocks:
            held.append(block)
            n += len(block[0])
            if n > most:
                held = [_by_kind(*(np.concatenate(p) for p in zip(*held)))]
                n = len(held[0][0])
                if 2 * n > most:
                    yield held[0]
                    held, n = [], 0
        if held:
            yield _by_kind(*(np.concatenate(p) for p in zip(*held)))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for keys, y, own, x in _buffers(batches, width):
            kinds, of = _kind_of(np.column_stack([y, x]))
            yield kinds, np.stack([np.bincount(of, weights(keys, t, spec.seed) * own, len(kinds)) for t in range(trees)], 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, w in summed(drawn(batches)):
            for lo in range(0, len(kinds), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in m[lo:lo + 10_000]], pa.binary()) for m in (kinds, w)], ["kind", "w"])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                yield tuple(np.frombuffer(b"".join(b.column(i).to_pylist())).reshape(b.num_rows, -1) for i in range(2))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, w in summed(stored(batches)):
            packs = [np.vstack([kinds[live, 0], w[live, t], kinds[live, 1:].T]).tobytes() for t in range(trees) for live in [w[:, t] > 0]]
            some = [t for t in range(trees) if packs[t]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([0] * len(some), pa.int32()), pa.array([packs[t] for t in some], pa.binary())], ["tree", "part", "rows"])
    counted = rows.mapInArrow(count, "kind binary, w binary")
    return counted.repartition(rows.sparkSession.sparkContext.defaultParallelism, "kind").mapInArrow(send, "tree int, part int, rows binary")


def _kind_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix, and the place of every row among them."""
    m = np.ascontiguousarray(m + 0.0)   # one zero
    codes = np.zeros(len(m), np.int64)
    for column in m.T:   # pairs of short numbers sort faster than rows
        values, at = np.unique(column, return_inverse=True)
        _, codes = np.unique(codes * len(values) + at, return_inverse=True)
    _, first = np.unique(codes, return_index=True)
    return m[first], codes


def _by_kind(kinds: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, of = _kind_of(kinds)
    out = np.zeros((len(found), w.shape[1]))
    np.add.at(out, of, w)
    return found, out


def _buffers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys, labels, weights and features of ``BUFFER_ROWS`` rows and more."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append((*(b.column(i).to_numpy() for i in range(3)), _matrix(b.column(3), width)))
            n += b.num_rows
        if n >= BUFFER_ROWS:
            yield tuple(np.concatenate(part) for part in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held))


def _by_node(leaf: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes reached and the places of their rows."""
    order = np.argsort(leaf, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], leaf[order[1:]] != leaf[order[:-1]]]))
    return leaf[order[starts]], np.split(order, starts[1:])


PART_SCHEMA = ("tree int, part int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, "
               "importance array<double>")
_PACKED = pa.schema([("block", pa.int64()), ("tree", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("data", pa.binary())])
_KINDS = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]


class ForestModel:
    """A finished forest; ``transform`` adds ``prediction`` and, with classes, ``probability``."""

    def __init__(self, spark: SparkSession, tops: Sequence[Top], parts: DataFrame, classes: int, width: int, spec: Spec):
        self.spark, self.tops, self.parts, self.classes, self.width, self.spec = spark, list(tops), parts, classes, width, spec

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of purity by feature, shares within every tree, averaged over the trees."""
        long = self.parts.select("tree", F.posexplode("importance").alias("f", "gain"))
        upper = [(t, f, float(g)) for t, top in enumerate(self.tops) for f, g in top.gain]
        if upper:
            long = long.unionByName(self.spark.createDataFrame(upper, "tree int, f int, gain double"))
        by = long.groupBy("tree", "f").agg(F.sum("gain").alias("gain"))
        share = by.join(by.groupBy("tree").agg(F.sum("gain").alias("all")), "tree").where("all > 0")
        found = {r["f"]: r["s"] for r in share.groupBy("f").agg(F.sum(F.col("gain") / F.col("all")).alias("s")).collect()}
        total = sum(found.values()) or 1.0
        return DenseVector([found.get(f, 0.0) / total for f in range(self.width)])

    def transform(self, df: DataFrame, trees: int | None = None) -> DataFrame:
        """Votes of the first ``trees`` trees, or of all."""
        trees = self.spec.trees if trees is None else trees
        parts = self.parts.where(F.col("tree") < trees)
        each = 24 + 8 * max(self.classes, 1)
        whole = (parts.agg(F.sum(F.size("feature").cast("long"))).head()[0] or 0) * each
        rows = df.withColumn("_x", vector_to_array(FEATURES)).drop(FEATURES)
        if whole <= PIECE_BYTES:
            out = self._add(rows.withColumn("_votes", F.array().cast("array<double>")), parts.drop("importance"), trees)
        else:
            out = self._gathered(rows, parts.drop("importance"), trees)
        out = out.withColumn(FEATURES, array_to_vector("_x"))
        if not self.classes:
            return out.withColumn("prediction", F.get("_votes", F.lit(0)) / F.lit(float(trees))).drop("_x", "_votes")
        share = F.transform("_votes", lambda v: v / F.lit(float(trees)))
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return out.withColumn("probability", array_to_vector(share)).withColumn("prediction", best.cast("double")).drop("_x", "_votes")

    def _add(self, df: DataFrame, parts: DataFrame, trees: int) -> DataFrame:
        """Votes by subtrees of no more than PIECE_BYTES, in every task."""
        names = ("feature", "threshold", "left", "right", "value")
        kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
        loaded = {(r["tree"], r["part"]): {n: np.array(r[n], k) for n, k in zip(names, kinds)} for r in parts.collect()}
        shared = self.spark.sparkContext.broadcast((loaded, [(top.arrays(), top.value) for top in self.tops[:trees]]))
        size, schema, width = max(self.classes, 1), df.schema, self.width

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            subtrees, tops = shared.value
            for b in batches:
                x = _matrix(b.column(b.schema.get_field_index("_x")), width)
                place = b.schema.get_field_index("_votes")
                votes = np.zeros((len(x), size))
                for t, (tree, values) in enumerate(tops):
                    leaf = walk(tree, x)
                    for i in np.unique(leaf):
                        here = np.flatnonzero(leaf == i)
                        if values[i] is not None:
                            if values[i]:
                                votes[here] += np.array(values[i])
                        elif (t, int(i)) in subtrees:
                            sub = subtrees[t, int(i)]
                            votes[here] += sub["value"].reshape(-1, size)[walk(sub, x[here])]
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(votes.ravel()))
                yield b.set_column(place, "_votes", column)
        return df.mapInArrow(vote, schema)

    def _gathered(self, df: DataFrame, parts: DataFrame, trees: int) -> DataFrame:
        """Rows go to their subtrees and the votes come back: nothing of the forest but its upper parts is held by every task."""
        df = cut(df.withColumn("_id", F.monotonically_increasing_id()))
        size, width = max(self.classes, 1), self.width
        shared = self.spark.sparkContext.broadcast([(top.arrays(), top.value) for top in self.tops[:trees]])
        packed = "block bigint, tree int, part int, at binary, data binary"

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "tree", "part", "at", "data"])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row per subtree with the rows that reach it; ``part`` -1 has the ids and the votes of closed leaves (``at`` holds ids)."""
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width)
                block = int(ids[0])
                yield batch_of([(block, -1, -1, ids.tobytes(), b"")])
                for t, (tree, values) in enumerate(shared.value):
                    rows = []
                    for node, here in zip(*_by_node(walk(tree, x))):
                        if values[node] is None:
                            rows.append((block, t, int(node), here.astype(np.int32).tobytes(), x[here].tobytes()))
                        elif values[node]:
                            rows.append((block, t, -1, here.astype(np.int32).tobytes(), np.tile(np.array(values[node], np.float64), len(here)).tobytes()))
                    if rows:
                        yield batch_of(rows)

        def vote(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if left.num_rows and right.num_rows:
                sub = {n: right.column(n).combine_chunks().flatten().to_numpy() for n in ("feature", "threshold", "left", "right", "value")}
                value = sub["value"].reshape(-1, size)
                for r in left.select(["block", "tree", "at", "data"]).to_pylist():
                    leaf = walk(sub, np.frombuffer(r["data"]).reshape(-1, width))
                    rows.append((r["block"], r["tree"], -1, r["at"], value[leaf].tobytes()))
            return pa.Table.from_batches([batch_of(rows)] if rows else [], schema=_PACKED)

        def total(group: pa.Table) -> pa.Table:
            """The votes of a block of rows, summed in the order of the trees."""
            rows = sorted(group.select(["tree", "at", "data"]).to_pylist(), key=lambda r: r["tree"])
            ids = np.frombuffer(rows[0]["at"], np.int64)
            votes = np.zeros((len(ids), size))
            for r in rows[1:]:
                votes[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["data"]).reshape(-1, size)
            return pa.table({"_id": ids, "_votes": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * size, pa.int32()), pa.array(votes.ravel()))})
        sent = cut(df.select("_id", "_x").mapInArrow(send, packed))
        voted = sent.where("part >= 0").groupBy("tree", "part").cogroup(parts.groupBy("tree", "part")).applyInArrow(vote, packed)
        votes = sent.where("part < 0").unionByName(voted).groupBy("block").applyInArrow(total, "_id bigint, _votes array<double>")
        return df.join(votes, "_id").drop("_id")

    def save(self, path: str) -> None:
        self.parts.write.mode("overwrite").parquet(f"{path}/parts")
        about = {"classes": self.classes, "width": self.width, "spec": asdict(self.spec), "tops": [vars(top) for top in self.tops]}
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        about = json.loads(spark.read.parquet(f"{path}/forest").head()["about"])
        tops = []
        for held in about["tops"]:
            top = Top(0)
            vars(top).update(held)
            tops.append(top)
        return cls(spark, tops, spark.read.schema(PART_SCHEMA).parquet(f"{path}/parts"), about["classes"], about["width"], Spec(**about["spec"]))

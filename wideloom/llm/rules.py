"""Quality rules: counted facts with fixed limits, then a calibrated logistic regression over hashed n-grams.

The model sees hashed words and byte 3-grams of the whole text (log counts, unit length).  It is trained on
a bounded sample of labelled rows, three quarters of it for the weights and a quarter for the calibration
(a logistic link on the margin), and scored in Arrow batches against a fixed threshold.

Null and empty texts have no words, so they fail the limits.  Without labels of both kinds the probability
is the share of good labels (1 without labels) and the limits alone decide.  Repeated rows are judged alike.
Columns other than id and text are not read; labels that are null are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wideloom.llm.common import map_rows, texts, words
from wideloom.llm.language import _link
from wideloom.llm.quality import training_rows

BUCKETS = 1 << 15
SAMPLE = 6_000          # bound on the labelled rows of the training
KEEP = 0.3              # probability of good quality from which a text that passes the limits is kept
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")


def facts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    tokens = words(text, lower=False)
    n = len(tokens)
    blank = sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = [x for x in text.encode().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        c = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, n)
        _, pair = np.unique(c[:-1] * len(seen) + c[1:], return_inverse=True)
        _, at, times = np.unique(pair[:-1] * len(seen) + c[2:], return_inverse=True, return_counts=True)
        again = times[at] >= 2
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i:n - 2 + i] |= again
        repeated = int(covered.sum())
    return n, len(text) - blank, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: log counts of words and byte 3-grams, scaled to unit length."""
    raw = (text or "").encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.split()), np.uint64) % np.uint64(BUCKETS)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    tri = (b[:-2] * np.uint32(65599) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(17) if len(b) > 2 else b[:0]
    n = np.bincount(np.concatenate([own.astype(np.int64), tri.astype(np.int64) + BUCKETS]), minlength=2 * BUCKETS)
    at = n.nonzero()[0]
    v = np.log1p(n[at])
    return at, v / (np.sqrt((v * v).sum()) or 1.0)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, text: str | None) -> float:
        at, v = hashed(text)
        z = float((self.weights[at] * v).sum()) * self.slope + self.offset
        return 1 / (1 + np.exp(-min(max(z, -40), 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.5, l2: float = 1e-6, seed: int = 3) -> Model:
    """Adagrad on the logistic loss over three quarters of the rows, the link on the rest."""
    if len(rows) == 0 or len(np.unique(y)) < 2:
        share = min(max(float(y.mean()) if len(rows) else 1.0, 1e-3), 1 - 1e-3)
        return Model(np.zeros(2 * BUCKETS), 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % 4 == 3
    w, squares, rng = np.zeros(2 * BUCKETS), np.full(2 * BUCKETS, 1e-6), np.random.default_rng(seed)
    use = (~held).nonzero()[0]
    for _ in range(epochs):
        rng.shuffle(use)
        for lo in range(0, len(use), batch):
            part = use[lo:lo + batch]
            at, v = (np.concatenate([rows[i][j] for i in part]) for j in (0, 1))
            doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(doc, w[at] * v, len(part))
            slip = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            slope = np.bincount(at, slip[doc] * v, 2 * BUCKETS) / len(part) + l2 * w
            squares += slope * slope
            w -= rate * slope / np.sqrt(squares)
    margin = np.array([(w[rows[i][0]] * rows[i][1]).sum() for i in held.nonzero()[0]])
    if len(np.unique(y[held])) < 2:
        return Model(w, 1.0, 0.0)
    return Model(w, *_link(margin, y[held]))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", allowed: Column | None = None, sample: int = SAMPLE) -> Model:
    """Hash the sampled rows in Spark; only their sparse vectors reach the driver."""
    def run(c):
        x = [hashed(t) for t in c["text"]]
        yield pa.RecordBatch.from_arrays([
            pa.array(c["doc_id"], pa.int64()), pa.array(c["label"], pa.int32()), pa.array([a.astype(np.int32) for a, _ in x], pa.list_(pa.int32())),
            pa.array([v.astype(np.float32) for _, v in x], pa.list_(pa.float32()))], ["doc_id", "label", "at", "v"])
    table = map_rows(training_rows(docs, labels, label, allowed, sample), run, "doc_id bigint, label int, at array<int>, v array<float>").toArrow()
    order = np.lexsort([table["label"].to_numpy(), table["doc_id"].to_numpy()])
    at, v = table["at"].combine_chunks(), table["v"].combine_chunks()
    rows = [(at[int(i)].values.to_numpy().astype(np.int64), v[int(i)].values.to_numpy().astype(np.float64)) for i in order]
    return fit(rows, table["label"].to_numpy()[order].astype(float) if len(order) else np.zeros(0))


def judge(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Facts, ``base_failed``, ``probability`` and ``kept`` of every row, in Arrow batches without a shuffle."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(c):
        f = np.array([facts(t) for t in c["text"]], np.int64).reshape(-1, 5)
        failed = (f[:, 0] < MIN_WORDS) | (100 * f[:, 4] > MAX_REPEAT_PERCENT * f[:, 0])
        p = np.array([model.probability(t) for t in c["text"]])
        yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), *[pa.array(f[:, i]) for i in range(5)], pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)],
                                         ["doc_id", *names, "base_failed", "kept", "probability"])
    return map_rows(texts(docs), run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, probability double")

"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits.  One binary n-gram classifier per bit tells the languages with
+1 from those with -1: log ratios of hashed byte n-gram frequencies, counted over all training texts in
Spark, and a logistic link fitted on a bounded sample.  Decoding sums the logistic loss of every codeword,
bits weighted by how well their classifier does on the sample; the nearest codeword wins, the softmax of the
losses is its score, and a small lead over the second is flagged as ambiguous.

Rows without a language are not learned from.  Null texts and texts without a letter are ``und`` with score
0 and not ambiguous; so is everything when nothing was learned.  With one language it is always that one.
Texts are used whole.  Repeated rows count as often as they occur.  Only id, text and language are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wideloom.llm.common import kept_sample, letters_present, map_rows
from wideloom.session import ship

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 4_000        # rows that the link functions and bit weights are fitted on
MARGIN = 0.7          # a smaller lead in weighted loss is ambiguous
SLICE = 1 << 19       # positions of a text handled at once
UNKNOWN = "und"


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed byte n-grams of the whole lower-cased text, in slices."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    for lo in range(0, len(raw), SLICE):
        b = raw[lo:lo + SLICE + max(ORDERS) - 1].astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = (h[:len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1:] + np.uint32(n)) if len(b) >= n else h[:0]
            if n in ORDERS:
                end = min(len(h), SLICE)
                yield ((h[:end] * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(math.log2(BUCKETS)))).astype(np.int64)


def codewords(k: int, seed: int = 7, tries: int = 200) -> np.ndarray:
    """``(languages, bits)`` of +1/-1: every split of up to 7 languages, else the most distant of random codes."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 7:
        return np.array([[1 if c >> i & 1 else -1 for c in range(1, 2 ** k - 1) if c & 1] for i in range(k)], float)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = math.ceil(10 * math.log2(k))
    for _ in range(tries):
        code = rng.choice([-1.0, 1.0], (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * bits
        if distance.min() > far:
            best, far = code, distance.min()
    return best


@dataclass(frozen=True)
class Model:
    names: list[str]
    code: np.ndarray      # (languages, bits)
    ratios: np.ndarray    # (buckets, bits)
    slope: np.ndarray     # (bits,)
    offset: np.ndarray
    weight: np.ndarray

    def evidence(self, text: str) -> np.ndarray:
        """Mean log ratio of the bits over all n-grams, grown with the root of the length."""
        total, n = np.zeros(self.ratios.shape[1]), 0
        for idx in buckets(text):
            total += self.ratios[idx].sum(0, dtype=np.float64)
            n += len(idx)
        return total / math.sqrt(n) if n else total

    def decode(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and the lead over the second, per row of ``evidence``."""
        z = evidence * self.slope + self.offset
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None, :, :]) @ self.weight
        order = np.sort(loss, 1)
        best = loss.argmin(1)
        score = 1 / np.exp(order[:, :1] - loss).sum(1)
        lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, np.clip(score, 0, 1), lead


def counts(rows: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all texts; every task sends one row per language and bucket at most."""
    def run(batches):
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = table.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for idx in buckets(text or ""):
                    own += np.bincount(idx, minlength=BUCKETS)
        for lang, own in table.items():
            at = own.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])
    ship(rows.sparkSession)
    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, allowed: Column | None = None, *, sample: int = SAMPLE) -> Model:
    """Counts over all allowed rows with a language; links and weights from at most ``sample`` of them."""
    if allowed is not None:
        docs = docs.where(allowed)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("string").alias("id"))
    rows = rows.where(F.col("lang").isNotNull() & letters_present(F.col("text")))
    table = counts(rows).toPandas()   # languages * buckets rows at most
    names = sorted(table["lang"].unique())
    k, code = len(names), codewords(len(names))
    bits = code.shape[1]
    if bits == 0:
        return Model(names, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.zeros(0), np.ones(0))
    n = np.zeros((k, BUCKETS))
    n[table["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    p = (n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BUCKETS)
    ratios = np.stack([np.log(p[code[:, b] > 0].mean(0) / p[code[:, b] < 0].mean(0)) for b in range(bits)], 1).astype(np.float32)
    model = Model(names, code, ratios, np.ones(bits), np.zeros(bits), np.ones(bits))

    def seen(c):
        e = [model.evidence(t or "") for t in c["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(c["lang"]), pa.array(e, pa.list_(pa.float64()))], ["lang", "e"])
    got = map_rows(kept_sample(rows, F.col("id"), sample), seen, "lang string, e array<double>").collect()
    e = np.array([r["e"] for r in got])
    y = code[[names.index(r["lang"]) for r in got]]
    slope, offset, weight = (np.zeros(bits) for _ in range(3))
    for b in range(bits):
        slope[b], offset[b] = _link(e[:, b], (y[:, b] + 1) / 2)
        wrong = np.mean((e[:, b] * slope[b] + offset[b] > 0) != (y[:, b] > 0))
        weight[b] = max(1 - 2 * wrong, 0.01)
    return Model(names, code, ratios, slope, offset, weight * bits / weight.sum() / max(bits / (k - 1), 1))


def _link(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic regression by damped Newton steps."""
    spread = x.std() or 1.0
    u, w = np.stack([x / spread, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        hess = (u * (p * (1 - p))[:, None]).T @ u / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(hess, u.T @ (p - y) / len(x) + ridge * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return float(w[0] / spread), float(w[1])


def predict(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row, in Arrow batches without a shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), letters_present(F.col("text").cast("string")).alias("some"))

    def run(c):
        some = np.array(c["some"], bool) & bool(model.names)
        at = some.nonzero()[0]
        names, scores, unsure = [UNKNOWN] * len(some), np.zeros(len(some)), np.zeros(len(some), bool)
        if len(at):
            if model.code.shape[1]:
                best, score, lead = model.decode(np.array([model.evidence(c["text"][i]) for i in at]))
            else:
                best, score, lead = np.zeros(len(at), int), np.ones(len(at)), np.full(len(at), np.inf)
            scores[at], unsure[at] = score, lead < margin
            for i, b in zip(at, best):
                names[i] = model.names[b]
        yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(names), pa.array(scores), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])
    return map_rows(rows, run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")

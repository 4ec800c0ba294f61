"""Quality classifier: gradient-boosted trees over statistics of the whole text.

Null and empty texts have all-zero statistics and get a score like any other row.  Repeated rows are
scored alike.  Without labels of both kinds the score is a constant (0.5 without any label).  Labels that
are null are ignored; labels of a document that does not exist are too.  Columns other than the id and the
text are never read.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wideloom.llm import gbt
from wideloom.llm.common import fold, kept_sample, map_rows, prepared, slices, texts

SAMPLE = 20_000    # bound on the labelled rows that the trees are fitted on
THRESHOLD = 0.3
NAMES = ("log_chars", "log_words", "word_len_mean", "word_len_std", "word_len_max_log", "distinct_words", "distinct_pairs",
         "top_word", "entropy", "same_neighbour", "lines_log", "line_words_log", "repeated_lines", "lower", "upper", "digit",
         "blank", "stops", "bang", "symbols", "pipes", "quotes", "other", "high", "upper_of_letters", "capital_words", "symbol_words")
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:", b"!?",
          b"#*$%&<>@^~=+_", b"|", b"\"'`()[]{}")


def _table() -> np.ndarray:
    kind = np.full(256, len(_KINDS), np.uint8)
    kind[128:] = len(_KINDS) + 1
    for i, letters in enumerate(_KINDS):
        kind[list(letters)] = i
    return kind


_KIND = _table()


def statistics(text: str | None) -> list[float]:
    """The numbers that the trees see, in the order of ``NAMES``; they cover the whole text."""
    raw = (text or "").encode()
    tokens = raw.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(tokens)
    sizes = np.fromiter(map(len, tokens), np.float64, n)
    freq = np.fromiter(counts.values(), np.float64, len(counts)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 2) / len(raw)
    letters = kinds[0] + kinds[1] + kinds[-1]
    sym = sum(1 for w in counts if not w[-1:].isalnum() and w[-1] in b"#*$%&|!")
    return [
        np.log1p(len(raw)), np.log1p(n), sizes.mean(), sizes.std(), np.log1p(sizes.max()), len(counts) / n,
        len(set(zip(tokens, tokens[1:]))) / max(n - 1, 1), freq.max(), float(-(freq * np.log(freq)).sum() / np.log(n + 1)),
        sum(map(eq, tokens, tokens[1:])) / n, np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        *kinds, kinds[1] / letters if letters else 0.0, sum(map(bytes.isupper, tokens)) / n, sym / len(counts),
    ]


def matrix(items: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in items], np.float64).reshape(len(items), len(NAMES))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None, sample: int) -> DataFrame:
    """``(doc_id, text, label)`` for at most ``sample`` labelled rows, chosen by hash of the id; the ids are broadcast."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")) \
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
    if allowed is not None:
        marked = marked.where(allowed)
    return texts(docs).join(F.broadcast(kept_sample(marked, F.col("doc_id"), sample)), "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", allowed: Column | None = None,
          sample: int = SAMPLE, **options) -> gbt.Trees:
    """Fit the trees on at most ``sample`` labelled rows; only their statistics reach the driver."""
    rows = training_rows(docs, labels, label, allowed, sample)

    def measured(c):
        x = matrix(c["text"])
        yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(c["label"], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])
    got = map_rows(rows, measured, "doc_id bigint, label int, x array<double>").orderBy("doc_id", "label", "x").collect()
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), len(NAMES))
    return gbt.fit(x, np.array([r["label"] for r in got], np.float64), **options)


def score(docs: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row, in Arrow batches without a shuffle."""
    def scored(c):
        p = model.probability(matrix(c["text"]))
        yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
    return map_rows(texts(docs), scored, "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text the model does not reject, without a shuffle."""
    def good(batches):
        for batch in batches:
            for part in slices(batch):
                items = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array(model.probability(matrix(items)) >= threshold))
    prepared(docs.sparkSession)
    return docs.mapInArrow(good, docs.schema)


def held_out(column: Column) -> Column:
    return fold(column, 5) == 0

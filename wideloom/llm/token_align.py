"""Alignment of two tokenizers over the byte offsets at which their tokens end.

The ends of both tokenizations are sorted lists.  The shorter one drives a galloping search through the longer:
every end starts where a coarser driver stopped, doubles its step until it has passed, then halves the range.
Ends in both lists cut the tokens into groups; differences of their ranks are the tokens of each group, and the
tokens that end there are linked.  Texts of a chunk lie behind one another, so one search serves them all.

How often a pair of ids is linked is counted over the whole corpus: chunks hand in their distinct pairs, a
grouped sum counts them, and each chunk gets back the counts of its own pairs only.

Null and empty texts, and texts that one side does not give back byte by byte, have no tokens: zeros and an
empty digest.  Repeated rows are aligned each on their own; a null id is kept.  Long texts are encoded in pieces
that no token crosses.  The chunks' tables go to the shared folder.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from wideloom.llm.common import map_rows, stored, texts
from wideloom.llm.tokens import Cutter, Memory, Vocabulary, parts

GROUP = 200                     # unknown units encoded together
COARSE = 16                     # every so many ends are searched first
NONE = np.zeros(0, np.uint32)
SINGLE = re.compile(r" \S+")      # one unit, also behind others

_TABLES: dict[str, tuple] = {}


def gallop(driver: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every value of the sorted ``driver`` the first place in the sorted ``ends`` that is not below it."""
    if len(driver) > COARSE:
        start = np.repeat(gallop(driver[::COARSE], ends), COARSE)[:len(driver)]
    else:
        start = np.zeros(len(driver), np.int64)
    last, low = len(ends), start.copy()
    high, step = start.copy(), 1
    active = np.flatnonzero(high < last)
    active = active[ends[high[active]] < driver[active]]
    while len(active):
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + step, last)
        step *= 2
        active = active[high[active] < last]
        active = active[ends[high[active]] < driver[active]]
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        below = ends[middle] < driver[active]
        low[active[below]] = middle[below] + 1
        high[active[~below]] = middle[~below]
        active = active[low[active] < high[active]]
    return low


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both sorted lists of the values they share; the shorter list drives."""
    if len(a) > len(b):
        return common(b, a)[::-1]
    at = gallop(a, b)
    shared = np.flatnonzero(at < len(b))
    shared = shared[b[at[shared]] == a[shared]]
    return shared, at[shared]


class ByteSide:
    """Ids of texts under a byte-level vocabulary, special strings read as plain text."""

    def __init__(self, path: str):
        if path not in _TABLES:
            vocabulary = Vocabulary(path)
            _TABLES[path] = (vocabulary.bytes_of, Cutter(path))
        self.bytes_of, self.cutter = _TABLES[path]
        self.lengths = _lengths(self.bytes_of)
        self.memory = Memory(self.encode)

    def encode(self, units: list[str]) -> list[bytes]:
        found: dict[str, list[int]] = {}
        single = list(filter(SINGLE.fullmatch, units))
        for lo in range(0, len(single), GROUP):
            found.update(self.together(single[lo:lo + GROUP]))
        rest = [u for u in units if u not in found]
        found.update(zip(rest, (e.ids for e in self.cutter.tokenizer.encode_batch(rest, add_special_tokens=False))))
        return [array("I", found[u]).tobytes() if b"".join(map(self.bytes_of.get, found[u])) == u.encode() else b"" for u in units]

    def together(self, units: list[str]) -> dict[str, list[int]]:
        """Units with one space before them, encoded as one text and told apart by their numbers."""
        e = self.cutter.tokenizer.encode("".join(units), add_special_tokens=False)
        ids, of = e.ids, np.array(e.word_ids, np.float64)
        if not np.array_equal(np.unique(of), np.arange(len(units))):
            return {}
        ends = np.searchsorted(of, np.arange(len(units)), "right").tolist()
        return {u: ids[lo:hi] for u, lo, hi in zip(units, [0, *ends], ends)}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, each distinct unit encoded once; none if they do not give the text back."""
        cut = [self.cutter.compounds(t) for t in texts]
        values, lo, out = self.memory.values(list(chain.from_iterable(cut))), 0, []
        for units in cut:
            mine = values[lo:lo + len(units)]
            out.append(NONE if b"" in mine else np.frombuffer(b"".join(mine), np.uint32))
            lo += len(units)
        return out


class PieceSide:
    """Ids of texts under a piece vocabulary that puts a space before them."""

    def __init__(self, path: str):
        if path not in _TABLES:
            from sentencepiece import SentencePieceProcessor
            model = SentencePieceProcessor(model_file=path)
            pieces = {i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(model.get_piece_size())}
            if any(re.search("[^▁]▁", model.id_to_piece(i)) for i in pieces):
                raise ValueError("this vocabulary joins signs across a space")
            _TABLES[path] = (pieces, model)
        self.bytes_of, self.model = _TABLES[path]
        self.lengths = _lengths(self.bytes_of)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with the space that the vocabulary puts before them; none if they do not give the text back."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return [np.array(ids, np.uint32) if b"".join(map(self.bytes_of.get, ids)) == t.encode() else NONE for t, ids in zip(texts, found)]


def _lengths(bytes_of: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(bytes_of) + 1, np.int64)
    for i, b in bytes_of.items():
        out[i] = len(b)
    return out


class Aligner:
    """Aligns the texts of one chunk after another; lives as long as a task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.signs: dict[bytes, np.ndarray] = {}

    def ids(self, side, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; none if those of a part do not give it back."""
        piece = [p for t in texts if t for p in parts(t)]
        owner = [i for i, t in enumerate(texts) if t for _ in parts(t)]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for i, ids in zip(owner, side.ids(piece)):
            found[i].append(ids)
        return [np.concatenate(f) if f and all(map(len, f)) else NONE for f in found]

    def numbers(self, side: str, sign: str) -> np.ndarray:
        """Decimal ids, each followed by ``sign``."""
        key = side + sign
        if key not in self.signs:
            n = len((self.a if side == "a" else self.b).lengths)
            self.signs[key] = np.array([b"%d%s" % (i, sign.encode()) for i in range(n)] + [None], object)[:-1]
        return self.signs[key]

    def chunk(self, texts: list[str | None]) -> dict:
        """Alignment of the texts: per text its numbers and digest, and its links by place in the distinct pairs."""
        spaced = [" " + t if t else "" for t in texts]
        pairs = [(x, y) if len(x) and len(y) else (NONE, NONE) for x, y in zip(self.ids(self.a, spaced), self.ids(self.b, spaced))]
        a, b = (np.concatenate([NONE, *ids]).astype(np.int64) for ids in (list(zip(*pairs)) or ((), ())))
        n_a, n_b = (np.array([len(p[side]) for p in pairs], np.int64) for side in (0, 1))
        rank_a, rank_b = common(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        first = np.searchsorted(rank_a, np.concatenate([[0], np.cumsum(n_a)]))      # groups before every text
        pairs, place, times = np.unique(a[rank_a] << 32 | b[rank_b], return_inverse=True, return_counts=True)
        tokens = self.listed(a, b, rank_a, rank_b, first)
        edge = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        lists = [b"".join(tokens[lo:hi]) for lo, hi in zip(edge, edge[1:])]
        links = place.astype(np.int32)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(first), "lists": lists,
                "links": [links[lo:hi].tobytes() for lo, hi in zip(first, first[1:])], "pairs": pairs, "times": times}

    def listed(self, a, b, rank_a, rank_b, first) -> list[bytes]:
        """All tokens in the order of the groups, A before B, each with the sign that follows it."""
        size_a, size_b = (np.diff(r, prepend=-1) for r in (rank_a, rank_b))
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[rank_a] = True
        last_b[rank_b] = True
        text_a = np.where(last_a, self.numbers("a", "|")[a], self.numbers("a", ",")[a])
        text_b = np.where(last_b, self.numbers("b", ";")[b], self.numbers("b", ",")[b])
        ending = rank_b[first[1:][np.diff(first) > 0] - 1]
        text_b[ending] = self.numbers("b", "")[b[ending]]
        out[np.arange(len(a)) + np.repeat(np.concatenate([[0], rank_b[:-1] + 1])[:len(size_a)], size_a)] = text_a
        out[np.arange(len(b)) + np.repeat(rank_a + 1, size_b)] = text_b
        return out.tolist()


FOUND = ("chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, groups_sha256 string, links binary, "
         "pairs array<bigint>, times array<bigint>")


def chunks(docs: DataFrame, a_path: str, b_path: str, *, with_groups: bool = False) -> DataFrame:
    """One row per document, and one per chunk (with ``pairs``) that holds its distinct pairs and how often it links them.

    Chunk numbers belong to one evaluation; store the result before reading it twice.
    """
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [f.split(" ")[0] for f in FOUND.split(", ")]

    def start():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner, number = Aligner(a_path, b_path), [TaskContext.get().partitionId() << 32]

        def run(c) -> Iterator[pa.RecordBatch]:
            got, n = aligner.chunk(c["text"]), len(c["text"])
            number[0] += 1
            none = [None] * n
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in got["lists"]]
            groups = [x.decode() for x in got["lists"]] if with_groups else none
            rows = [[number[0]] * n, c["doc_id"], got["n_a"], got["n_b"], got["n_groups"], groups, digests, got["links"], none, none]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)
            if len(got["pairs"]):
                last = [[number[0]], *[[None]] * 7, [got["pairs"]], [got["times"]]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(last, kinds)], names)
        return run
    return map_rows(texts(docs), start, FOUND, per_task=True)


def pair_counts(found: DataFrame) -> DataFrame:
    """``(pair, count, best)`` over all chunks: how often two ids are linked, and whether no other A id is linked to that B id more often."""
    listed = found.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counted = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))     # a B id has at most as many rows as A has ids
    return counted.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(b_id)))


def align(docs: DataFrame, a_path: str, b_path: str, *, with_groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` and, if wanted, ``groups`` as text."""
    found = stored(chunks(docs, a_path, b_path, with_groups=with_groups), "aligned")
    listed = found.where("pairs IS NOT NULL").select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    own = listed.join(pair_counts(found), "pair").select("of", "place", "count", "best")
    keep = ["doc_id", "n_a", "n_b", "n_groups", "groups", "groups_sha256"]
    rows = found.where("pairs IS NULL").select("chunk", *keep, "links")

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        count[place] = right.column("count").to_numpy()
        best[place] = right.column("best").to_numpy(zero_copy_only=False)
        links = [np.frombuffer(x, np.int32) for x in left.column("links").to_pylist()]
        sums = [[len(x) for x in links], [int(best[x].sum()) for x in links], [int(count[x].sum()) for x in links]]
        return pa.table([*[left.column(k) for k in keep], *[pa.array(s, pa.int64()) for s in sums]], [*keep, "n_links", "n_best", "count_sum"])
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint"
    out = rows.groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(counted, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))

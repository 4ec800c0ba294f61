"""Power-of-two packing: a document's ids are cut into pieces of binary length, and pieces of equal length
share a bucket.  A sequence is one piece, so no sequence crosses documents and none is padded.

Null and empty texts have just the end id.  Repeated rows are packed each on their own.  Ids of sequences
are unique within one evaluation of the result; store it before joining it with itself.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wideloom.llm.common import BLANKS, map_rows, texts

CONTEXT = 2048
END_ID = 1
CACHE_WORDS = 250_000   # distinct units in each of a worker's two memories
GROUP = 200             # unknown units encoded together
CACHE_CHARS = 40        # longer ones are encoded each time

_WORKER: dict = {}


# Texts of these characters are lower-cased and cut into the vocabulary's units here; all others between blanks.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t\n\ra-z0-9ß-öø-ſ]+")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, drops white space and never joins across its units (words, digits, runs of
    other signs), so units are encoded one by one and remembered.  Texts with rarer characters or with the
    strings of special tokens are cut only at ASCII blanks, which is always safe.  When the memory is full it
    becomes the older one, from which units in use are taken over; results do not depend on it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.units(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.older, new = {}, self.known, set().union(*cut)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        missing = list(new.difference(again))
        whole = [w for w in missing if UNITS.fullmatch(w) and PLAIN.fullmatch(w) and w == w.lower()]
        for lo in range(0, len(whole), GROUP):
            self.known.update(self.together(whole[lo:lo + GROUP]))
        self.known.update(self.alone([w for w in missing if w not in self.known]))
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for w in missing:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        if len(self.known) > CACHE_WORDS:   # one very long text
            self.known, self.older = {}, {}
        return out

    def together(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Units that the vocabulary does not cut further, with their ids; encoded as one text."""
        e = self.tokenizer.encode(" ".join(units), add_special_tokens=False)
        of, raw = np.array(e.word_ids, np.float64), array("I", e.ids).tobytes()
        if not np.array_equal(np.unique(of), np.arange(len(units))):
            return self.alone(units)
        ends = (4 * np.searchsorted(of, np.arange(len(units)), "right")).tolist()
        return zip(units, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)))

    def alone(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        found = self.tokenizer.encode_batch(units, add_special_tokens=False)
        return zip(units, (array("I", e.ids).tobytes() for e in found))

    @staticmethod
    def units(text: str) -> list[str]:
        if "<|" not in text and PLAIN.fullmatch(text):
            return UNITS.findall(text.lower())
        return [w for w in BLANKS.split(text) if w]


def encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def lengths(n: int, context: int) -> Iterator[int]:
    """Full contexts, then the powers of two of the rest, largest first."""
    yield from [context] * (n // context)
    rest = n % context
    for level in reversed(range(rest.bit_length())):
        if rest >> level & 1:
            yield 1 << level


def pack(docs: DataFrame, tokenizer: str, *, context: int = CONTEXT, end_id: int | None = END_ID, with_ids: bool = True,
         keep_units: bool = True) -> DataFrame:
    """One row per piece: its place in the document, its bucket (a power of two), its sequence, and its ids.

    Runs inside the map tasks without a shuffle.  ``sequence_id`` carries the bucket in its upper bits, so
    the sequences of a bucket have neighbouring ids.  ``write_buckets`` lays the pieces out by bucket.
    Workers remember units from task to task; without ``keep_units`` they start every task afresh and drop
    them at its end, which leaves their memory to the other stages of a long session and costs CPU time.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def start():
        mine = encoder(tokenizer) if keep_units else Encoder(tokenizer)
        return lambda c: cut(mine, c)

    def cut(mine, c):
        rows: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for doc, raw in zip(c["doc_id"], mine.encode(c["text"])):
            raw += tail
            total, at = len(raw) // 4, 0
            for size in lengths(total, context):
                piece = raw[4 * at:4 * (at + size)]
                rows["doc_id"].append(doc)
                rows["start"].append(at)
                rows["length"].append(size)
                rows["ids_crc32"].append(zlib.crc32(piece))
                rows["doc_tokens"].append(total)
                rows["ids"].append(piece if with_ids else None)
                at += size
        kinds = [pa.int64()] * 5 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))
    pieces = map_rows(texts(docs), start, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary", per_task=True)
    level = (F.length(F.bin("length")) - 1).cast("bigint")
    out = pieces.withColumn("sequence_id", level * F.lit(1 << 58) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return out if with_ids else out.drop("ids")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store packed pieces in one folder per length, ready to be read in batches of equal shape."""
    pieces.write.partitionBy("length").parquet(path)

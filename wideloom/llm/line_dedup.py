"""Substring dedup by lines or paragraphs: the earliest occurrence of a unit stays, the others can be cut out.

A text is cut into units that tile it: each carries the break behind it.  By default breaks are line ends and
the ends of sentences inside lines (``SENTENCES``), so that a passage set into other lines is found too;
``LINES`` and ``PARAGRAPHS`` cut there only.  A unit is normalised (lower case, runs of anything but letters
and digits to one blank, trimmed).  Units without a letter or digit are not numbered and never repeat.  Equal
normal forms are grouped by a 128-bit digest over all documents; the occurrence with the smallest (document id,
unit) is the kept one.

One repeated sentence says little, so a repeated unit is reported only in a run: neighbouring repeated units of
one text with ``min_run`` words in all (every eight characters count as a word at least, for scripts without
blanks).  ``min_run=0`` reports every repeated unit of ``min_words`` words or ``min_chars`` characters, alone or not.
A unit counts as repeated if ``min_docs`` documents hold it: 2, or 1 for repeats inside one document as well.

The units are stored once.  Grouping combines inside the map tasks.  Digests that hold more than 1/2000 of all
units, fewer than 2000 by construction, are broadcast; the others are joined by a shuffle without a heavy key.
Only repeated units are then ordered by text.

Offsets count code points of the original text, ends are exclusive.  Null and empty texts have no units.  Rows
with a null id are left as they are and do not count.  Rows that repeat an id and its text are one document and
repeat nothing of each other; rows of one id with other texts count each on their own.  Columns other than id and
text are not read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from wideloom.llm.common import map_rows, stored, texts

SENTENCES = r"[.!?][ \t\r\n]+|\n+|[。！？]"
LINES = r"\n"
PARAGRAPHS = r"\n{2,}"
MIN_RUN = 40
MIN_DOCS = 2
MIN_WORDS = 5
MIN_CHARS = 20
HOT_PARTS = 2000    # a digest in more than this part of all units is broadcast
_OTHER = re.compile(r"[\W_]+")


def normal(unit: str) -> str:
    return _OTHER.sub(" ", unit.lower()).strip()


def split(text: str, ends: re.Pattern) -> list[tuple[int, int, str]]:
    """``(start, end, normal form)`` of the units that hold a letter or digit."""
    marks = [m.end() for m in ends.finditer(text)]
    if not marks or marks[-1] < len(text):
        marks.append(len(text))
    found = [(lo, hi, normal(text[lo:hi])) for lo, hi in zip([0, *marks], marks)]
    return [u for u in found if u[2]]


def units(docs: DataFrame, breaks: str = SENTENCES) -> DataFrame:
    """``(doc_id, row, unit, start, end, words, chars, digest)`` of every unit, without a shuffle; ``row`` is a hash of the text."""
    ends = re.compile(breaks)

    def run(c):
        found = [split(t, ends) for t in c["text"]]
        flat, sizes = list(chain.from_iterable(found)), list(map(len, found))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(c["doc_id"], np.int64), sizes)), pa.array(np.repeat(np.array(c["row"], np.int64), sizes)),
            pa.array(chain.from_iterable(map(range, sizes)), pa.int32()), pa.array([u[0] for u in flat], pa.int32()), pa.array([u[1] for u in flat], pa.int32()),
            pa.array([u[2].count(" ") + 1 for u in flat], pa.int32()), pa.array([len(u[2]) for u in flat], pa.int32()),
            pa.array([xxhash.xxh3_128_digest(u[2].encode("utf-8", "surrogatepass")) for u in flat], pa.binary())],
            ["doc_id", "row", "unit", "start", "end", "words", "chars", "digest"])
    rows = texts(docs).where("doc_id IS NOT NULL AND text <> ''").withColumn("row", F.xxhash64("text"))
    return map_rows(rows, run, "doc_id bigint, row bigint, unit int, start int, end int, words int, chars int, digest binary")


def repeats(docs: DataFrame, breaks: str = SENTENCES, min_run: int = MIN_RUN, min_docs: int = MIN_DOCS,
            min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, unit, start, end, kept, kept_doc_id, kept_unit)`` for every occurrence of a repeated unit; ``kept`` marks the one that stays."""
    return _repeats(docs, breaks, min_run, min_docs, min_words, min_chars).drop("row")


def _repeats(docs: DataFrame, breaks: str, min_run: int, min_docs: int, min_words: int, min_chars: int) -> DataFrame:
    found = stored(units(docs, breaks), "units")
    if min_run <= 0:
        found = found.where((F.col("words") >= min_words) | (F.col("chars") >= min_chars))
    place = F.struct("doc_id", "row", "unit")
    groups = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    groups = groups.where("first <> last" if min_docs < 2 else "first.doc_id <> last.doc_id OR first.row <> last.row")
    groups = stored(groups.select("digest", "first", "n"), "repeated")
    hot = F.col("n") > found.count() / HOT_PARTS
    heavy, light = F.broadcast(groups.where(hot).drop("n")), groups.where(~hot).drop("n").hint("shuffle_hash")
    again = found.join(heavy, "digest").unionByName(found.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest"))
    again = again.drop("digest").distinct()   # identical rows
    if min_run > 0:
        of = Window.partitionBy("doc_id", "row")
        again = again.withColumn("run", F.col("unit") - F.row_number().over(of.orderBy("unit")))
        size = F.sum(F.greatest("words", F.floor(F.col("chars") / 8))).over(Window.partitionBy("doc_id", "row", "run"))
        again = again.withColumn("size", size).where(F.col("size") >= min_run)
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("unit") == F.col("first.unit")) & (F.col("row") == F.col("first.row"))
    return again.select("doc_id", "row", "unit", "start", "end", kept.alias("kept"), F.col("first.doc_id").alias("kept_doc_id"), F.col("first.unit").alias("kept_unit"))


@F.pandas_udf(StringType())
def _rest(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or t is None else "".join(t[lo:hi] for lo, hi in zip([0, *e], [*s, len(t)]))
                      for t, s, e in zip(text, starts, ends)], dtype=object)


def remove(docs: DataFrame, breaks: str = SENTENCES, min_run: int = MIN_RUN, min_docs: int = MIN_DOCS,
           min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all but the kept occurrences cut out of ``text``, and ``removed``: their numbers and original spans."""
    gone = _repeats(docs, breaks, min_run, min_docs, min_words, min_chars).where("NOT kept")
    gone = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("unit", "start", "end"))).alias("removed"))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(text).alias("row"), text.alias("text"))
    rest = _rest("text", F.col("removed.start"), F.col("removed.end"))
    return rows.join(gone, ["doc_id", "row"], "left").select(
        *[rest.alias(c) if c == "text" else _of(c) for c in docs.columns if c != "removed"], "removed")


def _of(column: str) -> Column:
    return F.col("all")[column].alias(column)

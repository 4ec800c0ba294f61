"""Small tables with the awkward cases, and plain brute-force versions of what the operators compute."""

from __future__ import annotations

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, schema=SCHEMA):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def clashing(df):
    """The same rows with extra columns named like those the operators make."""
    from pyspark.sql import functions as F
    names = ("score", "predicted", "held_out", "n", "rep", "label", "digest", "prefix", "w", "g", "base", "spans", "wide", "row", "kept", "start",
             "length", "ids", "sequence_id", "offset", "component_id", "n_shingles", "item_id", "lang_pred", "removed", "_gone", "_leak", "_id", "unit", "cut", "clean")
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t: str | None, k: int) -> frozenset:
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(sets: dict, percent: int) -> dict:
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}

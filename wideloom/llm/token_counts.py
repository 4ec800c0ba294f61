"""Exact token counts at every prefix of a text, by dynamic programming over its last tokens.

The encoding of a byte string ends in exactly one token that fits behind the encoding of what comes before it.
So one pass from left to right finds, for every prefix, its last token and with it the number of tokens.  A
token fits behind another if no merge across their border comes before the merges that built the two sides.
Every distinct unit of text is worked through once; the counts of a text are running sums over its units.

``prefix_table`` stores the counts of all prefixes (in characters, the empty one included), from which
``count_at`` and ``longest_within`` answer questions about truncation and budgets without encoding again.
Counts are those of the library, special strings included: inside a text they count as one token.

Null and empty texts have no bytes, no tokens and one prefix.  Repeated rows are counted each on their own; a
null id is kept.  Long texts are handled in pieces that tokens never cross, so memory follows the piece.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wideloom.llm.common import CHUNK_BYTES, map_rows, texts
from wideloom.llm.tokens import BLANK, CONTRACTIONS, Cutter, Memory, Vocabulary, parts

BLOCK = 65_536       # prefixes in one row of the stored table
LIMIT = 1024
SHORT = frozenset(CONTRACTIONS.split("|"))
PAIRS = 400_000      # remembered borders of two tokens

_TABLES: dict[str, Chains] = {}


class Chains:
    """Token counts of byte strings and all their prefixes under one vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.ends = ahocorasick.Automaton()
        for entry, token in v.id_of.items():
            self.ends.add_word(entry.decode("latin-1"), (len(entry), token))
        self.ends.make_automaton()
        self.before, self.last, self.count, self.steps = b"", [-1], [0], array("h")
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.merges: dict[int, dict[int, int]] = {}
        for (x, y), rank in v.rank.items():
            self.merges.setdefault(x, {})[y] = rank
        self.cutter = Cutter(path)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge while a token is built, each with the rank of the merge that ends it."""
        memo = self.right if side else self.left
        if token not in memo:
            out, until = [(token, 1 << 62)], token
            while until in self.vocabulary.halves:
                halves = self.vocabulary.halves[until]
                until = halves[side]
                out.append((until, halves[2]))
            memo[token] = out
        return memo[token]

    def fit(self, a: int, b: int) -> bool:
        """Whether ``b`` stays apart behind ``a``: no merge over the border wins.  Of equal ranks the left one goes first."""
        known, starts = True, self.edge(b, 0)
        for x, ends_x in self.edge(a, 1):
            merges = self.merges.get(x)
            if merges:
                for y, ends_y in starts:
                    rank = merges.get(y)
                    if rank is not None and rank < ends_x and rank <= ends_y:
                        known = False
                        break
                if not known:
                    break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[a, b] = known
        return known

    def work(self, raw: bytes) -> None:
        """Leave tokens, and changes of the count, of every prefix of a unit; what it shares with the one before is kept."""
        fits, fit, last, count, steps = self.fits, self.fit, self.last, self.count, self.steps
        now = 0
        for x, y in zip(raw, self.before):
            if x != y:
                break
            now += 1
        del last[now + 1:], count[now + 1:], steps[now:]
        for at, (n, token) in self.ends.iter(raw.decode("latin-1")):   # longest first at every place
            if at < now:
                continue
            if n <= at:
                key = last[at + 1 - n], token
                known = fits.get(key)
                if not (fit(*key) if known is None else known):
                    continue
            tokens = count[at + 1 - n] + 1
            steps.append(tokens - count[at])
            last.append(token)
            count.append(tokens)
            now = at + 1
        self.before = raw

    def counts(self, raw: bytes) -> list[int]:
        """Tokens of every prefix of one unit in bytes, from the empty one on."""
        self.work(raw)
        return self.count[:]

    def changes(self, text: str) -> bytes:
        """Changes of the count from character to character of a unit with the blanks before it, as 16-bit numbers."""
        first = text[1:2] if text[0] == " " else text[0]
        if first and not first.isspace() and text not in SHORT:   # no blanks but one space: a single unit
            self.work(text.encode())
            if len(self.steps) == len(text):
                return self.steps.tobytes()
            counts = [self.count[end] for end in accumulate(len(c.encode()) for c in text)]
            return array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()
        counts = self.compound(text)
        return array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def unit(self, text: str) -> list[int]:
        """Tokens of every prefix in characters, from one character on."""
        raw = text.encode()
        count = self.counts(raw)
        if len(raw) == len(text):
            return count[1:]
        return [count[i + 1] for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]

    def compound(self, text: str) -> list[int]:
        """The same for a unit with the blanks before it; as long as only blanks are there, they are one unit."""
        blanks = BLANK.match(text).group()
        rest = text[len(blanks):]
        if not rest or blanks == " " or not blanks and rest not in SHORT:
            return self.unit(text)
        if rest in SHORT and not blanks.endswith(" "):
            head = self.spaces(blanks)
            tail = [self.unit(rest[0])[0], *[self.unit(rest[0])[0] + n for n in self.unit(rest[1:])]]
            tail[-1] = self.unit(rest)[-1]
        else:
            lead = " " if blanks.endswith(" ") else ""
            head = (self.unit(blanks[:-1])[-1] if len(blanks) > 1 else 0) if lead else self.spaces(blanks)
            tail = self.unit(lead + rest)[len(lead):]
        return (self.unit(blanks) if blanks else []) + [head + n for n in tail]

    def spaces(self, blanks: str) -> int:
        """Tokens of blanks before a unit that takes none of them: the last sign is a unit of its own unless it is a space's."""
        if not blanks:
            return 0
        return sum(self.unit(u)[-1] for u in self.cutter.units(blanks + "x")[:-1])


def chains(path: str) -> Chains:
    if path not in _TABLES:
        _TABLES[path] = Chains(path)
    return _TABLES[path]


class Counter:
    """Token counts of whole texts at every prefix; lives as long as a task."""

    def __init__(self, path: str):
        self.chains = chains(path)
        special = self.chains.vocabulary.special
        self.special = sorted(special, key=lambda s: (-len(s), s))
        self.memory = Memory(lambda units: map(self.chains.changes, units))   # sorted, so neighbours share their beginnings

    def segments(self, text: str) -> Iterator[tuple[str, str]]:
        """Stretches of plain text, each with the special string behind it."""
        while self.special:
            at, found = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(-1, ""), key=lambda f: f[0])
            if at < 0:
                break
            yield text[:at], found
            text = text[at + len(found):]
        yield text, ""

    def prefixes(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """``(number of the text, tokens of its prefixes from one character on)``, in pieces of bounded length."""
        queue, size, self.at = [], 0, -1
        for i, text in enumerate(texts):
            for segment, special in self.segments(text) if "<" in text else [(text, "")]:
                for part in parts(segment):
                    queue.append((i, self.chains.cutter.compounds(part), ""))
                    size += len(part)
                    if size > CHUNK_BYTES:
                        yield from self.looked_up(queue)
                        queue, size = [], 0
                if special:
                    queue.append((i, [], special))
        yield from self.looked_up(queue)

    def looked_up(self, queue: list[tuple[int, list[str], str]]) -> Iterator[tuple[int, np.ndarray]]:
        """Counts of the queued pieces; what a text has so far is carried from call to call."""
        steps, lo = self.memory.values([u for _, units, _ in queue for u in units]), 0
        for i, units, special in queue:
            if i != self.at:
                self.at, self.base, self.unit = i, 0, ""
            if units:
                found = self.base + np.cumsum(np.frombuffer(b"".join(steps[lo:lo + len(units)]), np.int16), dtype=np.int64)
                lo, self.base, self.unit = lo + len(units), int(found[-1]), units[-1]
                yield i, found
            if special:   # a part of the special string is ordinary text, which may join the unit before it
                before = self.base - self.total(self.unit)
                yield i, np.array([*[before + self.total(self.unit + special[:k]) for k in range(1, len(special))], self.base + 1], np.int64)
                self.base, self.unit = self.base + 1, ""

    def total(self, text: str) -> int:
        return sum(self.chains.compound(u)[-1] for u in self.chains.cutter.compounds(text))


def count(docs: DataFrame, tokenizer: str, *, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_chars, n_tokens, over_limit, fit_chars)``: ``fit_chars`` is the longest prefix, in characters, of
    at most ``limit`` tokens."""
    def start():
        counter = Counter(tokenizer)

        def run(c):
            texts = [t or "" for t in c["text"]]
            tokens, chars, fit = ([0] * len(texts) for _ in range(3))
            for i, piece in counter.prefixes(texts):
                if int(piece.min()) <= limit:
                    fit[i] = chars[i] + int(np.flatnonzero(piece <= limit)[-1]) + 1
                chars[i] += len(piece)
                tokens[i] = int(piece[-1])
            size = [len(t.encode()) for t in texts]
            columns = [c["doc_id"], size, chars, tokens, [n > limit for n in tokens], fit]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, [*[pa.int64()] * 4, pa.bool_(), pa.int64()])], names)
        return run
    schema = "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return map_rows(texts(docs), start, schema, per_task=True)


def prefix_table(docs: DataFrame, tokenizer: str, *, block: int = BLOCK) -> DataFrame:
    """``(doc_id, block, counts)``: element i of a block is the count of the prefix of ``block * size + i`` characters."""
    def start():
        counter = Counter(tokenizer)

        def run(c):
            for i, text in enumerate(c["text"]):
                rest, number = np.zeros(1, np.int64), 0
                for _, piece in counter.prefixes([text or ""]):
                    rest = np.concatenate([rest, piece])
                    while len(rest) > block:
                        yield row(c["doc_id"][i], number, rest[:block])
                        rest, number = rest[block:], number + 1
                yield row(c["doc_id"][i], number, rest)
        return run

    def row(doc, number, counts):
        return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([number], pa.int64()),
                                           pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "block", "counts"])
    return map_rows(texts(docs), start, "doc_id bigint, block bigint, counts array<int>", per_task=True)


def count_at(prefixes: DataFrame, questions: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``questions(doc_id, n_chars)`` with ``n_tokens`` of that prefix; null where a document is shorter."""
    asked = questions.withColumn("_block", F.floor(F.col("n_chars") / block)).alias("q")
    stored = prefixes.select(F.col("doc_id").alias("_doc"), F.col("block").alias("_b"), "counts")
    joined = asked.join(stored, (F.col("q.doc_id") == F.col("_doc")) & (F.col("_block") == F.col("_b")), "left")
    return joined.select("q.*", F.get("counts", (F.col("n_chars") % block).cast("int")).cast("bigint").alias("n_tokens")).drop("_block")


def longest_within(prefixes: DataFrame, budget: int | Column, *, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_chars, n_tokens)``: the longest prefix of every document with at most ``budget`` tokens."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    places = F.transform("counts", lambda c, i: F.when(c <= limit, F.struct((F.col("block") * block + i).alias("n_chars"), c.cast("bigint").alias("n_tokens"))))
    best = prefixes.select("doc_id", F.array_max(places).alias("m"))
    return best.groupBy("doc_id").agg(F.max("m").alias("m")).select("doc_id", "m.n_chars", "m.n_tokens")

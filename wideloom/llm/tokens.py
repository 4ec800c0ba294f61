"""Pieces of text that a tokenizer never joins, and bounded memories for what is known about them.

A byte-level vocabulary cuts texts into units (runs of letters, digits, signs or blanks with one blank before
them) and a piece vocabulary never joins across the start of a run of blanks.  Both facts let the operators
look at every distinct unit once, whatever the length of the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import regex

from wideloom.llm.common import CHUNK_BYTES

MEMORY_UNITS = 200_000        # units in each of the two halves of a memory
MEMORY_BYTES = 40_000_000     # bytes of units and values in each half
LONG_UNIT = 200               # longer units are looked at each time
PART = 200_000                # characters of a long text that are handled together

CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"   # fixed by the vocabulary
SPACE = r"\p{White_Space}"
RUN = rf"\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+"
UNITS = regex.compile(rf"{CONTRACTIONS}| ?(?:{RUN})|{SPACE}+(?![^{SPACE}])|{SPACE}+")
BLANK = regex.compile(rf"{SPACE}*")
# Signs that every Unicode version sorts alike, and their kinds.
PLAIN_END = 0x558
PLAIN = re.compile(rf"[\x00-{chr(PLAIN_END - 1)}]*")


def _kind(pattern: str) -> str:
    return "".join(rf"\u{c:04x}" for c in range(PLAIN_END) if regex.fullmatch(pattern, chr(c)))


# A unit, or blanks together with the unit behind them: how blanks are cut depends on what follows.
_S, _L, _N = _kind(SPACE), _kind(r"\p{L}"), _kind(r"\p{N}")
_RUN = rf"[{_L}]+|[{_N}]+|[^{_S}{_L}{_N}]+"
COMPOUNDS = re.compile(rf"{CONTRACTIONS}| ?(?:{_RUN})|[{_S}]+(?:(?<! )(?:{CONTRACTIONS})|{_RUN})?")
SAFE_CUT = regex.compile(r"(?<=[!-~]) (?=[A-Za-z0-9])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in pieces that join to it, cut before single blanks inside ASCII, where no token crosses."""
    lo = 0
    while len(text) - lo > size:
        found = SAFE_CUT.search(text, lo + size)
        if not found:
            break
        yield text[lo:found.start()]
        lo = found.start()
    yield text[lo:]


def byte_alphabet() -> dict[str, int]:
    """The printable sign that stands for each byte: itself where printable, else the next free sign from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Entries, merges and special strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
        of = byte_alphabet()
        entry = lambda s: bytes(of[c] for c in s)
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"] if t["special"]}
        names = {s: i for s, i in raw["model"]["vocab"].items() if s not in self.special}
        self.id_of = {entry(s): i for s, i in names.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank, self.halves = {}, {}
        for rank, pair in enumerate(raw["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = names[a], names[b]
            self.rank[left, right] = rank
            self.halves.setdefault(names[a + b], (left, right, rank))


class Cutter:
    """Cuts a text into the units of a byte-level vocabulary, joined with the blanks before them.

    Texts with rarer signs are cut by the library, whose Unicode version then decides.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def units(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return UNITS.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def compounds(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return COMPOUNDS.findall(text)
        out, blanks = [], ""
        for unit in self.units(text):
            if BLANK.fullmatch(unit):
                blanks += unit
            else:
                out.append(blanks + unit)
                blanks = ""
        return out + [blanks] if blanks else out


class Memory:
    """What is known about units, in two halves: when one is full it becomes the older, from which units in use
    are taken over.  Results do not depend on it; long units are never kept."""

    def __init__(self, compute: Callable[[list[str]], Iterable], units: int = MEMORY_UNITS, size: int = MEMORY_BYTES):
        self.compute, self.units, self.size = compute, units, size
        self.known: dict = {}
        self.older: dict = {}
        self.held = 0

    def values(self, units: list[str]) -> list:
        """The value of every unit, in order."""
        out = list(map(self.known.get, units))
        missing = {u for u, v in zip(units, out) if v is None}
        if missing:
            fresh = {u: self.older[u] for u in missing if u in self.older}
            new = sorted(missing.difference(fresh))
            fresh.update(zip(new, self.compute(new)))
            out = [fresh[u] if v is None else v for u, v in zip(units, out)]
            self.keep(fresh)
        return out

    def keep(self, fresh: dict) -> None:
        for u, v in fresh.items():
            if len(u) <= LONG_UNIT:
                if len(self.known) >= self.units or self.held > self.size:
                    self.known, self.older, self.held = {}, self.known, 0
                self.known[u] = v
                self.held += 3 * len(u) + (len(v)) + 150


"""Repair of conversations against a walk through the states of the grammar, and its SQL."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, difference

from wideloom.llm import catalog, conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def walk(signs):
    """``(cost, audit)`` by a state machine that may insert up to three turns between any two."""
    inserted = {0: 2, 1: 2, 2: 3, 3: 2}

    def close(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                way = (cost + 3, audit + "I")
                if way < best.get(inserted[state], (1 << 60, "")):
                    best[inserted[state]] = way
        return best
    best = close({0: (0, "")})
    for sign in signs:
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 4, "D")]
            if sign != "X":
                late = 3 * sign.isupper()
                if state == 0 and sign.lower() == "s":
                    ways.append((1, late, "K"))
                to = "a" if state == 2 else "u"
                ways.append((3 if to == "a" else 2, late + 3 * (sign.lower() != to), "K" if sign.lower() == to else "R"))
            for now, more, letter in ways:
                after[now] = min(after.get(now, (1 << 60, "")), (cost + more, audit + letter))
        best = close(after)
    return min(best[s] for s in (0, 3) if s in best)


def price(signs, audit):
    at = total = 0
    for letter in audit:
        total += {"I": 3, "D": 4, "R": 3, "K": 0}[letter]
        if letter != "I":
            total += 3 * (letter != "D" and signs[at].isupper() and signs[at] != "X")
            at += 1
    assert at == len(signs)
    return total


def signs(rng, n):
    return "".join(rng.choices("suaoSUAOX", [1, 5, 5, 1, 1, 2, 2, 1, 2], k=n))


def test_alignment_against_the_walk():
    rng = random.Random(1)
    for _ in range(4000):
        s = signs(rng, rng.randrange(13))
        assert cv.align(s)[:2] == walk(s), s


@pytest.mark.parametrize("block", [2, 4, 16])
def test_blocks_give_the_whole_alignment(monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        s = signs(rng, rng.randrange(70))
        audit = cv.repair(s)
        assert (price(s, audit), audit) == walk(s), s


def test_band_leaves_cells_out():
    s = "ua" * 8
    turns = cv.Turns(s)
    assert len(turns.table(s, 0)[0]) == 1 and len(turns.table(s, 14)[0]) < len(cv.Turns(s).table(s, 100)[0])


def plain(rows, harm=True):
    """The contract, row by row."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20 if harm else 9
        role, text = " " if role is None else role, " " if text is None else text
        held = convs.setdefault(conv, [])
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            held += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in held:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        marks = []
        for (_, role, _), f in zip(held, faults):
            initial = role[0] if role and role[0] in "sua" else "o"
            marks.append("X" if f in ("blank", "duplicate") else initial.upper() if f else initial)
        cost, audit = walk("".join(marks))
        total, lines, at, state = sum(c != "D" for c in audit), [], 0, 0
        names = (["s"] if total % 2 else []) + ["user", "assistant"] * (total // 2)
        for letter in audit:
            if letter != "D":
                name = names[len(lines)]
                lines.append(f"{held[at][1] if letter == 'K' else name}:{held[at][2] if letter in 'KR' else ''}")
            at += letter != "I"
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "ünknown"])
            text = rng.choice(["Fine.", "What?", "No end", " ", "", None, "日本!\n", f"T{turn}.", f"word {turn}", "a\x0b"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows + rows[:7] + [(1000 + i, 0, "user", "Alone.") for i in range(40)]


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_against_the_contract(spark):
    rows = made(3, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("copies", "audit", "pos", "block", "cost", "_long", "n")])
    want = plain(rows)
    assert result(cv.repair_damaged(extra.repartition(7))) == want
    assert any(not r[7] for r in want)


def test_long_conversations_take_the_other_path(spark):
    rows = made(5, 25) + [(500, i, "user" if i % 2 else "assistant", f"Turn {i % 90}{'.' if i % 7 else ''}") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert result(cv.repair_damaged(df, long_rows=3)) == want
    assert result(cv.repair_damaged(df, long_rows=100)) == want
    assert result(cv.repair_damaged(df, long_bytes=0)) == want


def test_long_text_and_empty_tables(spark):
    rows = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y. " * 800_000), (2, None, None, None)]
    assert result(cv.repair_damaged(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert cv.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    name = "op11_conversation_repair"
    assert difference(catalog.QUERIES[name](spark, path), connect(path), catalog.ORACLES[name]) is None

"""Repair of the turn structure of conversations by alignment with the strings of a grammar, ``(s?(ua)+)?``.

The turns of a conversation become one sign each: the initial of the role, in capitals when the text is cut off,
or X when the turn is blank or repeated and has to go.  Every feasible length of the alternating grammar string is
a target; Wagner and Fischer's table of the turns against the target gives its cheapest edits.  Targets are taken
by their least possible cost, the best cost so far bounds the diagonals of each table (Ukkonen's band) and ends
the search, and tables of equal cost are traced back and their audits compared: the least one wins.

Long conversations are cut into blocks of turns.  A block's tables give its cost from every state of the grammar
to every other, sums of which from the end say what each state still costs; with these as tails, each block is
aligned again and traced from the state in which the one before it ended.  Cost and audit are those of one whole
alignment, as an audit is never a prefix of another with the same cost.  A conversation above ``LONG_ROWS`` turns
or ``LONG_BYTES`` of text is handled so across tasks, and no task holds its texts; only its digest, which is of
all its text in order, has to be taken by one task, which reads the turns as a stream.

Null roles and texts count as one space, null turns come first and are ignored for gaps, a null conversation id is
a conversation.  Turns of equal number are ordered by role and text.  Repeated rows are turns of their own.  A
conversation without rows has zeros, an empty audit and the digest of nothing.  Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wideloom.llm.common import free, shared_path, sized, stored
from wideloom.session import ship

# The cost of edits.
RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLOCK = 16                # turns aligned at once; a power of two
LONG_ROWS = 4096
LONG_BYTES = 4_000_000
NEVER = 1 << 40

BLANK = re.compile(r"[\x20\x09-\x0D]*")
ENDS = (".", "!", "?")
BLANKS = " \t\n\x0b\x0c\r"
# States of the grammar: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LAST = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
ACCEPTED = ((START, 0), (AFTER_A, 0))
NAMES = {"u": "user", "a": "assistant"}


def targets(state: int, longest: int) -> Iterator[str]:
    """The strings that lead on from ``state``, up to a length."""
    yield ""
    heads = {START: ("s", ""), AFTER_S: ("",), AFTER_U: ("",), AFTER_A: ("",)}[state]
    for head in heads:
        turn = "au" if state == AFTER_U else "ua"
        for n in range(0 if head else 1, longest - len(head) + 1):
            yield head + (turn * (n // 2 + 1))[:n]


def end_state(state: int, target: str) -> int:
    return LAST[target[-1]] if target else state


class Turns:
    """The turns that can stay, with what each costs against a sign of the target."""

    def __init__(self, signs: str):
        self.signs = [s for s in signs if s != "X"]
        self.cut_off = [s.isupper() for s in self.signs]
        self.cost = [{c: (0 if s.lower() == c else RETYPE if c in NAMES else NEVER) + (CUT_OFF if s.isupper() else 0) for c in "sua"} for s in self.signs]
        self.least = CUT_OFF * sum(self.cut_off)
        self.cheap = DELETE - CUT_OFF if any(self.cut_off) else DELETE

    def bound(self, length: int) -> int:
        """No alignment with a target of this length costs less."""
        n, late = len(self.signs), sum(self.cut_off)
        if length >= n:
            return self.least + INSERT * (length - n)
        return self.least + (DELETE - CUT_OFF) * min(n - length, late) + DELETE * max(n - length - late, 0)

    def straight(self, target: str) -> int:
        """Cost of pairing turns and signs one by one: an upper bound."""
        n = min(len(self.signs), len(target))
        rest = target[n:]
        return (sum(self.cost[i][target[i]] for i in range(n)) + DELETE * (len(self.signs) - n)
                + (NEVER if "s" in rest else INSERT * len(rest)))

    def table(self, target: str, limit: int) -> list[list[int]] | None:
        """Cost of the rest from every cell of the band ``limit`` allows; cell (i, j) is at ``[i][j - i - low]``."""
        n, m = len(self.signs), len(target)
        spare, final = limit - self.least, len(target) - n
        way = lambda k: INSERT * k if k > 0 else -self.cheap * k
        low = high = 0
        while low > -n and way(low - 1) + way(final - low + 1) <= spare:
            low -= 1
        while high < m and way(high + 1) + way(final - high - 1) <= spare:
            high += 1
        if not low <= final <= high:
            low, high = min(low, final), max(high, final)
        width = high - low + 1
        below: list[int] = []
        rows: list[list[int]] = []
        for i in range(n, -1, -1):
            row = [NEVER] * width
            for k in range(min(high, m - i), max(low, -i) - 1, -1):
                j, at = i + k, k - low
                if i == n and j == m:
                    row[at] = 0
                    continue
                best = NEVER
                if j < m:
                    if at + 1 < width and target[j] != "s":
                        best = INSERT + row[at + 1]
                    if i < n:
                        best = min(best, self.cost[i][target[j]] + below[at])
                if i < n and at:
                    best = min(best, DELETE + below[at - 1])
                row[at] = best
            rows.append(row)
            below = row
        rows.reverse()
        self.low = low
        return rows

    def trace(self, rows: list[list[int]], target: str) -> str:
        """The least audit of the cheapest edits: at every cell the first letter that stays on a cheapest way."""
        i = j = 0
        audit, n, m, low = [], len(self.signs), len(target), self.low
        while i < n or j < m:
            at = j - i - low
            here = rows[i][at]
            if i < n and at and here == DELETE + rows[i + 1][at - 1]:
                audit.append("D")
                i += 1
            elif j < m and target[j] != "s" and at + 1 < len(rows[i]) and here == INSERT + rows[i][at + 1]:
                audit.append("I")
                j += 1
            else:
                audit.append("K" if self.signs[i].lower() == target[j] else "R")
                i, j = i + 1, j + 1
        return "".join(audit)


@lru_cache(maxsize=50_000)
def align(signs: str, state: int = START, tails: tuple[tuple[int, int], ...] = ACCEPTED) -> tuple[int, str, int]:
    """``(cost, audit, end state)`` of the cheapest edits from ``state``; an end state adds its tail to the cost compared.

    ``signs`` are at most a block.  Without a feasible target the cost is ``NEVER``.
    """
    turns, tail = Turns(signs), dict(tails)
    n = len(turns.signs)
    found = []
    for target in targets(state, 2 * n + 3):
        end = end_state(state, target)
        if end in tail:
            found.append((turns.bound(len(target)) + tail[end], turns.straight(target) + tail[end], target, tail[end]))
    if not found:
        return NEVER, "", state
    found.sort(key=lambda f: (f[0], f[2]))
    best, audit, reached = min(f[1] for f in found), None, ""
    for bound, _, target, after in found:
        if bound > best:
            break
        rows = turns.table(target, best - after)
        cost = rows[0][-turns.low] + after
        if cost >= NEVER or cost > best:
            continue
        text = turns.trace(rows, target)
        if cost < best or audit is None or text < audit:
            best, audit, reached = cost, text, target
    if audit is None:
        return NEVER, "", state
    end = end_state(state, reached)
    gone = signs.count("X")
    return best - tail[end] + DELETE * gone, restored(signs, audit) if gone else audit, end


def restored(signs: str, audit: str) -> str:
    """The audit with the deletion of every X put where it comes first."""
    out, at = [], 0
    for letter in audit + "$":
        while at < len(signs) and signs[at] == "X":
            out.append("D")
            at += 1
        out.append(letter)
        at += letter in "KRD"
    return "".join(out[:-1])


@lru_cache(maxsize=20_000)
def block_costs(signs: str) -> tuple[int, ...]:
    """Cost of a block from every state to every state, row by row."""
    return tuple(align(signs, state, ((end, 0),))[0] for state in range(4) for end in range(4))


def before(costs: tuple[int, ...] | list[int], after: list[int]) -> list[int]:
    """What every state costs before a block, from what it costs behind it."""
    return [min(min(costs[4 * state + end] + after[end] for end in range(4)), NEVER) for state in range(4)]


def tails_of(after: list[int]) -> tuple[tuple[int, int], ...]:
    least = min(after)
    return tuple((end, cost - least) for end, cost in enumerate(after) if cost < NEVER)


def repair(signs: str) -> str:
    """The least audit of the cheapest edits of a whole conversation."""
    if len(signs) <= BLOCK:
        return align(signs)[1]
    blocks = [signs[i:i + BLOCK] for i in range(0, len(signs), BLOCK)]
    after = [[0, NEVER, NEVER, 0]]
    for signs in reversed(blocks[1:]):
        after.append(before(block_costs(signs), after[-1]))
    out, state = [], START
    for signs, behind in zip(blocks, reversed(after)):
        _, audit, state = align(signs, state, tails_of(behind))
        out.append(audit)
    return "".join(out)


def sign(role: str, text: str, repeated: bool) -> str:
    """The sign of a turn: X to delete, else its initial, in capitals when cut off."""
    if repeated or BLANK.fullmatch(text):
        return "X"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if text.rstrip(BLANKS).endswith(ENDS) else initial.upper()


class Report:
    """One conversation: its counts, and its repaired text as a running digest."""

    COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def __init__(self, conv):
        self.conv, self.turns, self.first, self.last, self.before = conv, 0, None, None, None
        self.blank = self.repeated = self.cut_off = self.illegal = self.cost = self.written = 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.state = START

    def seen(self, turn, role: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None:
            self.illegal += self.before[:1] + role[:1] not in ("su", "ua", "au")
        self.before = role
        self.blank += fault == "blank"
        self.repeated += fault == "duplicate"
        self.cut_off += fault == "truncated"

    def write(self, line: str) -> None:
        self.digest.update((("\n" if self.written else "") + line).encode())
        self.written += 1

    def apply(self, letters: str, role: str | None = None, text: str = "", cut_off: bool = False) -> None:
        """Letters of the audit up to and with the one that takes a turn; without a turn, insertions only."""
        self.audit.append(letters)
        for letter in letters:
            if letter == "D":
                self.cost += DELETE
                continue
            if letter == "K":
                self.state = LAST[role[:1]]
                self.write(f"{role}:{text}")
            else:
                self.state = AFTER_A if self.state == AFTER_U else AFTER_U
                self.cost += INSERT if letter == "I" else RETYPE
                name = NAMES["a" if self.state == AFTER_A else "u"]
                self.write(f"{name}:{text if letter == 'R' else ''}")
            if letter != "I" and cut_off:
                self.cost += CUT_OFF

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.repeated, self.cut_off, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def per_turn(audit: str) -> list[str]:
    """The audit cut behind every letter that takes a turn; what is left is behind the last."""
    return re.findall("I*[KRD]|I+$", audit)


SCHEMA = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")
KINDS = [*[pa.int64()] * 7, pa.string(), pa.string()]


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: the rows after the damage that a hash of their number deals out."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.when(harm == 4, "user").otherwise(part("role")).alias("role"), F.when(harm == 0, "").otherwise(text).alias("text"),
                       F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"))


def repaired(turns: DataFrame, *, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text, copies)``: faults, cost, audit and digest of the repair."""
    n, size = F.sum("copies"), F.sum(F.octet_length("text") * F.col("copies"))
    large = stored(turns.groupBy("conv_id").agg(n.alias("n"), size.alias("size")).where((F.col("n") > long_rows) | (F.col("size") > long_bytes))
                   .select(F.col("conv_id").alias("_long")), "long")
    if large.isEmpty():
        return _short(turns)
    ids = sized(large)
    same = turns["conv_id"].eqNullSafe(ids["_long"])
    return _short(turns.join(ids, same, "left_anti")).unionByName(_long(turns.join(ids, same, "left_semi")))


def _batch(reports: list[Report]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*[r.row() for r in reports]), KINDS)], list(Report.COLUMNS))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            yield from zip(*[c.to_pylist() for c in batch.slice(lo, 500).columns])


def _short(turns: DataFrame) -> DataFrame:
    """Conversations that fit a task many times over, one after another in sorted partitions."""
    def finish(conv, turns: list[tuple]) -> Report:
        report, seen, signs = Report(conv), set(), []
        for turn, role, text in turns:
            s = sign(role, text, (role, text) in seen)
            fault = "" if s.islower() else "truncated" if s != "X" else "blank" if BLANK.fullmatch(text) else "duplicate"
            report.seen(turn, role, fault)
            seen.add((role, text))
            signs.append(s)
        letters = per_turn(repair("".join(signs)))
        for (_, role, text), s, part in zip(turns, signs, letters):
            report.apply(part, role, text, s.isupper() and s != "X")
        for part in letters[len(turns):]:
            report.apply(part)
        return report

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for conv, turn, role, text, copies in _rows(batches):
            if now is not None and now[0] != conv:
                out.append(finish(now[0], held))
                held = []
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            now = (conv,)
            held += [(turn, role, text)] * copies
        if now is not None:
            out.append(finish(now[0], held))
            yield _batch(out)
    ship(turns.sparkSession)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def _long(turns: DataFrame) -> DataFrame:
    """Conversations of any length: blocks of turns are aligned in tasks of their own."""
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*order)
    spread = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = stored(rows.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "turns")
    first = rows.groupBy("conv_id", F.sha2(F.concat_ws("\x01", F.octet_length("role"), "role", "text"), 256).alias("d")).agg(F.min("pos").alias("pos"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    complete = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marked = rows.join(first.select("pos", F.lit(True).alias("new")), "pos", "left")
    fault = F.when(blank, "blank").when(F.col("new").isNull(), "duplicate").when(~complete, "truncated").otherwise("")
    letter = F.when(fault.isin("blank", "duplicate"), "X").when(fault == "truncated", F.upper(initial)).otherwise(initial)
    marked = stored(marked.select("conv_id", "pos", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block"), fault.alias("fault"), letter.alias("sign")), "signs")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda s: s["sign"])
    blocks = stored(_mapped(marked.groupBy("conv_id", "block").agg(F.concat_ws("", pieces).alias("signs")), _costs,
                            "conv_id bigint, block bigint, signs string, costs array<bigint>"), "blocks")
    behind = blocks.select("conv_id", "block", "signs", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    behind = _mapped(behind, _behind, "conv_id bigint, block bigint, signs string, after array<bigint>").repartition("conv_id", "block")
    ways = stored(_mapped(behind, _ways, "conv_id bigint, block bigint, audits array<string>, ends array<int>"), "ways")
    keyed = [rows.select("pos", "turn", "role", "text").join(marked, "pos"), ways.withColumnRenamed("conv_id", "_c").withColumnRenamed("block", "_b")]
    same = keyed[0]["conv_id"].eqNullSafe(keyed[1]["_c"]) & (F.col("block") == F.col("_b"))
    every = keyed[0].join(keyed[1], same).select("conv_id", "pos", "block", "turn", "role", "text", "fault", "audits", "ends")
    done = stored(_mapped(every.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), _told, SCHEMA), "repaired")
    free(rows, marked, blocks, ways)
    return done


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in fn(_rows(batches)):
            out.append(row)
            if len(out) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), types)], names)
    return df.mapInArrow(run, schema)


def _costs(rows):
    for conv, block, signs in rows:
        yield conv, block, signs, list(block_costs(signs))


def _behind(rows):
    """What every state costs behind each block; blocks come last first."""
    now, after = None, []
    for conv, block, signs, costs in rows:
        if now is None or now[0] != conv:
            now, after = (conv,), [0, NEVER, NEVER, 0]
        yield conv, block, signs, after
        after = before(costs, after)


def _ways(rows):
    """The audit of each block and the state it ends in, from every state."""
    for conv, block, signs, after in rows:
        found = [align(signs, state, tails_of(after)) for state in range(4)]
        yield conv, block, [f[1] for f in found], [f[2] for f in found]


def _told(rows):
    """The reports of conversations whose turns come in order, each with the ways through its block."""
    report, block, letters, state = None, None, [], START
    for conv, _, at, turn, role, text, fault, audits, ends in rows:
        if report is None or report.conv != conv:
            if report is not None:
                yield _end(report, letters)
            report, block, letters, state = Report(conv), None, [], START
        if at != block:
            for rest in letters:
                report.apply(rest)
            letters, block = per_turn(audits[state])[::-1], at
            state = ends[state]
        report.seen(turn, role, fault)
        report.apply(letters.pop(), role, text, fault == "truncated")
    if report is not None:
        yield _end(report, letters)


def _end(report: Report, letters: list[str]) -> tuple:
    for rest in letters:
        report.apply(rest)
    return report.row()


def repair_damaged(rows: DataFrame, **limits: int) -> DataFrame:
    """Damage ``rows(conv_id, turn, role, text)`` and repair what is left."""
    shared_path(rows.sparkSession)   # refuses a cluster without a shared folder before any work
    return repaired(damaged(rows), **limits)

"""Near copies, repeated lines and benchmark items against brute force, with the awkward cases."""

import random
import re

import numpy as np
import pytest
from helpers import clashing, frame, groups, shingles

from wideloom.llm import decontaminate, line_dedup, ngram_join


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 4, 5, 8, 9, 10, 12, 17, 20, 40, 80, 160])
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if words:
                    at = rng.randrange(len(words))
                    words[at:at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at].upper()], [words[at], rng.choice(vocabulary)]])
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(size)) + (" \t" + passage if rng.random() < 0.3 else "")))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "Only three WORDS"), (n + 4, "only three words")]


@pytest.mark.parametrize("k,percent,hot", [(4, 85, 32), (5, 80, 2), (1, 60, 1)])
def test_classes_match_brute_force(spark, k, percent, hot):
    rows = corpus(k)
    sets = {i: shingles(t, k) for i, t in rows}
    want = groups(sets, percent)
    got = ngram_join.jaccard_classes(clashing(frame(spark, rows)), k=k, percent=percent, hot=hot).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), want[i]) for i in sets)


def test_boundary_and_hot_limit_change_nothing(spark, monkeypatch):
    rows = corpus(9)
    want = groups({i: shingles(t, 4) for i, t in rows}, 85)
    monkeypatch.setattr(ngram_join, "boundary", lambda mean, percent: 60)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 2)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 1)
    got = ngram_join.jaccard_classes(frame(spark, rows), k=4, percent=85, hot=3).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_many_near_copies_make_few_pairs(spark):
    """A group of n copies that differ in one word each is found with pairs in the order of n, not its square."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i % 100] + [f"x{i}"] + base[i % 100 + 1:])) for i in range(400)]
    got = ngram_join.jaccard_classes(frame(spark, rows), k=4, percent=85).collect()
    assert {r.component_id for r in got} == {0}


def test_copies_that_miss_a_hub_make_few_pairs(spark, monkeypatch):
    """Copies of which only some link with each other: pairs that are compared grow with the copies, and no link is lost."""
    rng = random.Random(3)
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 2, 3])):
            words[at] = f"x{i}.{at}"
        rows.append((i, " ".join(words)))
    possible, compared = ngram_join._possible, []
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 4)   # two, as set, leave more pairs to the exact last step
    monkeypatch.setattr(ngram_join, "_possible", lambda pairs, *rest: (compared.append(pairs.count()), possible(pairs, *rest))[1])
    got = ngram_join.jaccard_classes(frame(spark, rows), k=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == groups({i: shingles(t, 4) for i, t in rows}, 85)
    assert sum(compared) < 12 * len(rows)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(5, text), (5, text), (3, text + " more"), (None, text), (8, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(frame(spark, rows), k=4, percent=85).collect())
    assert got == [(3, 28, 3), (5, 27, 3), (5, 27, 3), (8, 0, 8)]
    kept = ngram_join.drop_near_copies(clashing(frame(spark, rows + [(9, "a b"), (9, "a b")])), k=4, percent=85)
    assert sorted(((r.doc_id is None, r.doc_id or 0)) for r in kept.collect()) == [(False, 3), (False, 8), (False, 9), (True, 0)]


def test_join_of_an_empty_table(spark):
    assert ngram_join.jaccard_classes(frame(spark, [])).collect() == []
    assert ngram_join.drop_near_copies(frame(spark, [])).collect() == []


def test_short_sets_hash_apart():
    a, b, c = ngram_join.gram_sets(["a b", "b a", "A  b"], 4)
    assert a.tolist() == c.tolist() != b.tolist() and len(a) == 1


def test_prefix_puts_hot_grams_last():
    grams, hot = np.arange(10), np.array([0, 1, 5])
    assert ngram_join.prefix(grams, 4, hot).tolist() == [2, 3, 4, 6]
    assert ngram_join.prefix(grams, 9, hot).tolist() == [2, 3, 4, 6, 7, 8, 9, 0, 1]


# Benchmark items

def _words(t):
    return re.findall(r"[^\W_]+", t.lower())


def _leaks(docs, items, k=5, percent=80):
    out = set()
    for d, t in docs:
        if d is None or not t:
            continue
        w = _words(t)
        for i, item in items:
            v = _words(item or "")
            n = min(k, len(v))
            want = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if n else set()
            have = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if n else set()
            if want and 100 * len(want & have) >= percent * len(want):
                out.add((d, i, len(want & have), len(want)))
    return sorted(out)


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 9, 20, 40, 90]))) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, text(30))]
    items.append((94, items[-1][1]))
    docs = []
    for i in range(60):
        t = text(rng.choice([3, 50, 900, 3000]))
        if i % 2:
            words = rng.choice(items[:40])[1].split()
            for _ in range(i % 4):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            t = t + " " + " ".join(words).upper() + "! " + t[:50]
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, items[43][1] + "."), (None, items[43][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.leaks(clashing(frame(spark, docs)), bench).collect()
    want = _leaks(docs, items)
    assert sorted(map(tuple, got)) == want and len(want) > 20
    gone = {d for d, *_ in want}
    kept = decontaminate.drop_leaks(clashing(frame(spark, docs)), bench)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(d for d, _ in docs if d is not None and d not in gone)


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.leaks(frame(spark, []), bench).collect() == []
    assert decontaminate.leaks(frame(spark, [(1, "a b c d e f")]), bench.limit(0)).collect() == []
    assert decontaminate.leaks(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f")]), bench).collect() == [(1, 1, 2, 2)]


def test_decontamination_is_native(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    plan = decontaminate.leaks(frame(spark, [(1, "a b c d e f")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# Lines

def _units(text, breaks):
    out, at, norm = [], 0, lambda u: " ".join(re.findall(r"[^\W_]+", u.lower()))
    for part in re.findall(f"(?s).*?(?:{breaks})|.+", text or ""):
        if norm(part):
            out.append((len(out), at, at + len(part), norm(part)))
        at += len(part)
    return out


def _repeats(docs, breaks, min_run, min_docs=2, min_words=5, min_chars=20):
    rows = [(d, *u) for d, t in sorted({x for x in docs if x[0] is not None}, key=lambda x: x[0]) for u in _units(t, breaks)]
    if not min_run:
        rows = [r for r in rows if len(r[4].split()) >= min_words or len(r[4]) >= min_chars]
    places = {}
    for r in rows:
        places.setdefault(r[4], []).append(r[:2])
    again = [r for r in rows if len(places[r[4]]) > 1 and (min_docs < 2 or len({d for d, _ in places[r[4]]}) > 1)]
    held = {r[:2]: max(len(r[4].split()), len(r[4]) // 8) for r in again}
    out = []
    for r in again:
        lo = hi = r[1]
        while (r[0], lo - 1) in held:
            lo -= 1
        while (r[0], hi + 1) in held:
            hi += 1
        if not min_run or sum(held[r[0], i] for i in range(lo, hi + 1)) >= min_run:
            first = places[r[4]][0]
            out.append((*r[:4], first == r[:2], *first))
    return sorted(out)


@pytest.mark.parametrize("breaks,min_run,min_docs", [(line_dedup.SENTENCES, 12, 2), (line_dedup.LINES, 0, 1), (line_dedup.PARAGRAPHS, 9, 1), (line_dedup.SENTENCES, 0, 2)])
def test_passages_match_brute_force(spark, breaks, min_run, min_docs):
    rng = random.Random(2)
    lines = ["Lorem ipsum dolor sit amet. ", "lorem  IPSUM, dolor sit amet\n", "one two three four\n", "ä ö ü ß é!\n\n", "😀 a b c d e? ", "...\n", "3.5 is not. An end\n"]
    lines += [f"own {i} a b c d.\r\n" for i in range(40)]
    docs = [(i, "".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(40)] + [(50, None), (51, ""), (52, "\n\n"), (None, lines[0])]
    docs += [docs[3], docs[3], (60, "".join(lines * 20) + "only here it says so. " * 3), (61, "x" * 3000 + "\n" + "".join(lines[:3]))]
    want = _repeats(docs, breaks, min_run, min_docs)
    got = line_dedup.repeats(clashing(frame(spark, docs)), breaks, min_run, min_docs).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 10
    for r in line_dedup.remove(clashing(frame(spark, docs[:44])), breaks, min_run, min_docs).collect():
        gone = [w for w in _repeats(docs[:44], breaks, min_run, min_docs) if w[0] == r.doc_id and not w[4]]
        text = dict(docs[:44])[r.doc_id]
        assert r.text == (text and "".join(ch for i, ch in enumerate(text) if not any(w[2] <= i < w[3] for w in gone)))
        assert [tuple(x) for x in r.removed or []] == [w[1:4] for w in gone]


def test_heavy_digests_change_nothing(spark, monkeypatch):
    docs = [(i, f"same line of five words\nown {i} line of six words\n{'second same line. ' * (i % 3)}") for i in range(50)]
    want = sorted(map(tuple, line_dedup.repeats(frame(spark, docs), min_run=5).collect()))
    monkeypatch.setattr(line_dedup, "HOT_PARTS", 1)
    assert sorted(map(tuple, line_dedup.repeats(frame(spark, docs), min_run=5).collect())) == want == _repeats(docs, line_dedup.SENTENCES, 5)


def test_passages_of_an_empty_table(spark):
    assert line_dedup.repeats(frame(spark, [])).collect() == []
    assert line_dedup.remove(frame(spark, [])).collect() == []


def test_long_lines_without_blanks_count(spark):
    line = "这是一个没有空格的段落它很长但只算一个词所以从前总是留下"
    got = line_dedup.repeats(frame(spark, [(1, f"{line}\n短行"), (2, f"短行\n{line}。")]), line_dedup.LINES, 0).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, len(line) + 1, True, 1, 0), (2, 1, 3, 3 + len(line) + 1, False, 1, 0)]

"""Search by text against scores of every pair."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wideloom.operators import runlog, textsearch


def plain(entries, queries, k):
    words = lambda t: Counter("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    counts = {i: words(t) for i, t in entries}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(entries)) / (1 + n)) + 1 for t, n in df.items()}

    def scaled(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}
    vectors = {i: scaled(c) for i, c in counts.items()}
    out = {}
    for q, text in queries:
        asked = scaled(words(text))
        scores = {i: round(sum(w * v.get(t, 0) for t, w in asked.items()), 9) for i, v in vectors.items() if set(v) & set(asked)}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        if best:
            out[q] = [(i, scores[i]) for i in best]
    return out


def got(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_a_full_scan(spark, seed):
    rng = random.Random(seed)
    pool = ["the", "of"] * 12 + [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)]
    text = lambda n: " ".join(rng.choices(pool, k=n))
    entries = [(i, text(rng.randrange(1, 30))) for i in range(250)] + [(900, None), (901, ""), (902, "...")] + [(950 + i, "the same words w1") for i in range(90)]
    queries = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(100, None), (101, "unseen only"), (102, "the same words w1")]
    index = textsearch.build(spark.createDataFrame(entries, "id int, content string").repartition(5))
    asked = spark.createDataFrame(queries, "query_id int, content string")
    want = plain(entries, queries, 4)
    found = got(textsearch.search(index, asked, 4))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for q in want for a, b in zip(found[q], want[q]))


def test_entries_of_optional_lists_are_not_scored(spark):
    entries = [(i, "common word here" if i % 3 else f"common word rare{i % 9} alpha beta") for i in range(600)]
    index = textsearch.build(spark.createDataFrame(entries, "id int, content string"))
    asked = spark.createDataFrame([(1, "common rare3 alpha")], "query_id int, content string")
    assert textsearch.candidates(index, asked, 5, "query_id", "content").count() < 300
    want = plain(entries, [(1, "common rare3 alpha")], 5)[1]
    assert [i for i, _ in got(textsearch.search(index, asked, 5))[1]] == [i for i, _ in want]


def test_collections_and_empty_tables(spark):
    import datetime as dt
    rows = [{"id": f"e{i}", "content": c, "tags": t, "timestamp": dt.datetime(2024, 1, 1)} for i, (c, t) in enumerate(
        [("model forest accuracy 0.9", ["model_performance"]), ("feature ratio impact", ["feature_engineering"]), ("forest of features", ["feature_engineering"])])]
    texts = runlog.text_rows(spark, rows)
    assert [r["id"] for r in textsearch.search_texts(texts, "random forest model").orderBy(F.desc("score")).collect()] == ["e0", "e2"]
    assert [r["id"] for r in textsearch.search_texts(texts, "forest", tags=["feature_engineering"]).collect()] == ["e2"]
    assert textsearch.search_texts(texts.limit(0), "forest").count() == 0


def test_frequent_terms_are_not_shuffled(spark, monkeypatch):
    """Broadcast limits change the plan only; few terms of queries and frequent ones of entries need no shuffle of the lists."""
    rows = [(i, " ".join(["all", f"even{i % 2}", f"w{i % 7}", f"only{i}"] * (1 + i % 3))) for i in range(60)]
    texts = spark.createDataFrame(rows, "id long, content string")
    asked = spark.createDataFrame([(0, "even1 w3 only17"), (1, "all w5"), (2, "nothing")], "query_id long, content string")
    found = []
    for limit in (0, 12, 200_000):      # none, the most frequent, all
        monkeypatch.setattr(textsearch, "SMALL_ROWS", limit)
        index = textsearch.build(texts)
        found.append(sorted(textsearch.search(index, asked, 4).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 8
    counts = textsearch.term_counts(texts, "id", "content")
    plan = textsearch._joined(counts, index.lists.select("term", "idf"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

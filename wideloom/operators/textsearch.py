"""Search by text: TF-IDF weights in an inverted index, best matches without scoring every entry.

A list holds the entries of a term with their weights, and knows its largest weight.  A query's terms are ordered by
what they can add at most.  The list of the first gives a score that the k-th best cannot fall below; terms that
together cannot reach it are optional: an entry found only there is never looked at.  The entries in the other lists are
summed up, those that cannot reach the bound any more are dropped, and only the rest is looked up in optional lists.

The terms of the queries are broadcast if they are few, so that the lists are read where they are stored; an entry's rows
are stored together, so its sums are complete within a task.

Weights are ``(1 + ln n) * (ln((1 + N) / (1 + df)) + 1)``, scaled to length one per entry; a score is the sum over the
query's terms, scaled alike, so it is the cosine.  Null and empty texts have no terms and are never found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from wideloom.session import cut

WORD = r"[\p{L}\p{N}]+"
DIGITS = 9     # scores are rounded to these before they are ranked, so equal ones tie
SMALL_ROWS = 200_000   # terms that are broadcast, counted first; more are joined by a shuffle


@dataclass(frozen=True)
class TextIndex:
    """``postings(term, id, weight)`` and ``lists(term, idf, top)``."""

    postings: DataFrame
    lists: DataFrame


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return texts.select(F.col(key).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def _small(terms: DataFrame) -> DataFrame:
    """A stored table of terms, marked for a broadcast if it is short."""
    return F.broadcast(terms) if terms.count() <= SMALL_ROWS else terms


def _joined(counts: DataFrame, lists: DataFrame) -> DataFrame:
    """Counts with their term's columns: up to ``SMALL_ROWS`` of the most frequent terms are broadcast, only the rows of rare ones are shuffled."""
    room, limit = SMALL_ROWS, None
    for r in lists.groupBy("idf").count().orderBy("idf").collect():   # one row per number of entries that hold a term
        room -= r["count"]
        if room < 0:
            break
        limit = r["idf"]
    if limit is None:
        return counts.join(lists, "term")
    common = F.broadcast(lists.where(F.col("idf") <= limit))
    found = counts.join(common, "term")
    if room >= 0:
        return found
    rare = counts.join(common.select("term"), "term", "left_anti").join(lists.where(F.col("idf") > limit), "term")
    return found.unionByName(rare)


def _scaled(counts: DataFrame, lists: DataFrame, *keep: str) -> DataFrame:
    """Weights of length one per id; terms that no entry has are left out.  The rows of an id come out together."""
    raw = _joined(counts, lists.select("term", "idf", *keep)).withColumn("raw", (1 + F.log("n")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("id")))
    return raw.select("id", "term", (F.col("raw") / norm).alias("weight"), *keep)


def build(texts: DataFrame, key: str = "id", text: str = "content") -> TextIndex:
    """Index of all entries; lists are spread by term and id, so a frequent term is no single task."""
    counts = cut(term_counts(texts, key, text))
    total = texts.count()
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = cut(frequency.select("term", (F.log(F.lit(1.0 + total) / (F.col("df") + 1)) + 1).alias("idf")))
    postings = cut(_scaled(counts, idf).select("term", "id", "weight"))
    lists = idf.join(postings.groupBy("term").agg(F.max("weight").alias("top")), "term")
    return TextIndex(postings, cut(lists))


def search(index: TextIndex, queries: DataFrame, k: int = 5, *, key: str = "query_id", text: str = "content") -> DataFrame:
    """``(query_id, id, score, rank)``: the k best entries of every query, equal scores by id."""
    return _ranked(candidates(index, queries, k, key, text), k, key)


def _ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    score = F.round("score", DIGITS)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc(score), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(key), "id", score.alias("score"), "rank")


def candidates(index: TextIndex, queries: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """``(q, id, score)`` of all entries whose score can be among the k best, scores complete."""
    asked = _scaled(term_counts(queries, key, text), index.lists, "top").withColumnRenamed("id", "q")
    bound = F.col("weight") * F.col("top")
    order = W.partitionBy("q").orderBy(F.desc("bound"), "term")
    asked = cut(asked.withColumn("bound", bound).withColumn("nth", F.row_number().over(order)).withColumn(
        "rest", F.sum("bound").over(order.rowsBetween(0, W.unboundedFollowing))).withColumnRenamed("weight", "asked"))
    found = lambda terms: index.postings.join(_small(terms), "term").withColumn("part", F.col("asked") * F.col("weight"))
    first = found(asked.where("nth = 1").select("q", "term", "asked"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("part")))
    least = first.withColumn("place", place).where(F.col("place") == k).select("q", (F.col("part") - 10.0 ** -DIGITS).alias("least"))
    judged = cut(asked.join(least, "q", "left").withColumn("optional", F.coalesce(F.col("rest") < F.col("least"), F.lit(False))))
    open_ = judged.groupBy("q").agg(F.sum(F.when(F.col("optional"), F.col("bound")).otherwise(0.0)).alias("open"), F.first("least").alias("least"))
    summed = found(judged.where("NOT optional").select("q", "term", "asked")).groupBy("q", "id").agg(F.sum("part").alias("part"))
    able = F.coalesce(F.col("part") + F.col("open") >= F.col("least"), F.lit(True))
    left = cut(summed.join(open_, "q").where(able).select("q", "id", "part"))
    optional = judged.where("optional").select(F.col("q").alias("_q"), "term", "asked")
    wanted = left.join(optional, F.col("q") == F.col("_q")).select("q", "id", "term", "asked")
    lists = index.postings.join(_small(optional.select("term").distinct()), "term", "left_semi")
    added = wanted.join(lists, ["term", "id"]).select("q", "id", (F.col("asked") * F.col("weight")).alias("part"))
    return left.unionByName(added).groupBy("q", "id").agg(F.sum("part").alias("score"))


def search_texts(texts: DataFrame, words: str, k: int = 5, *, tags: list[str] | None = None, index: TextIndex | None = None) -> DataFrame:
    """The k entries of a stored collection nearest to ``words``, with ``score``; ``tags`` keeps those sharing any, after the search."""
    asked = texts.sparkSession.createDataFrame([(0, words)], "query_id int, content string")
    best = search(index or build(texts), asked, k).drop("query_id")
    out = texts.join(F.broadcast(best), "id")   # k rows
    return out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else out

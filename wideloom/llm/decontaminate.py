"""Benchmark decontamination: size-partitioned MinHash containment search with an exact check.

An item leaks into a document when ``100 * |item & document| >= percent * |item|`` over distinct word
n-grams (letters and digits, lower-cased).  The signature of an item is its ``m`` smallest gram hashes
(bottom-m MinHash).  Items are partitioned by size in powers of two; a partition whose largest item has
``q`` grams takes ``m = q - ceil(percent * q / 100) + 1``, so a leak must hold at least one signature gram:
candidates have no false negatives, however long the document is.  The largest hash in the signatures of
all partitions bounds what a document has to show: its other grams never leave the scan.  Candidates are
verified by counting shared grams exactly.

Only DataFrame functions are used.  The whole text is searched.  Null and empty texts leak nothing.
Items that are null or have no word match nothing; an item with fewer than ``k`` words is one gram, its
whole sequence of words.  Items that repeat a text are found each; rows that repeat a document id count as
one document and their grams are joined.  Rows with a null id cannot be reported and are left alone.
Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wideloom.llm.common import only, stored, texts, without


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; the empty array for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def grams(words: Column, k: int) -> Column:
    """Hashes of the ``k``-word grams with repeats; the empty array for fewer words."""
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(
        F.zip_with(F.sequence(F.lit(1), F.size(words)), words, lambda i, w: F.when(
            i + (k - 1) <= F.size(words), F.xxhash64(F.lit(k), *[F.get(words, i + (j - 1)) for j in range(k)]))))


def _item_grams(benchmark: DataFrame, k: int) -> DataFrame:
    """``(item_id, width, g)``: distinct grams; short items are one gram as wide as they are."""
    cut = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), tokens(F.col("text")).alias("w")).where("size(w) > 0 AND item_id IS NOT NULL")
    parts = None
    for width in range(1, k + 1):
        own = cut.where(F.size("w") >= k if width == k else F.size("w") == width)
        got = own.select("item_id", F.lit(width).alias("width"), F.explode(F.array_compact(grams(F.col("w"), width))).alias("g"))
        parts = got if parts is None else parts.unionByName(got)
    return parts.distinct()


def signatures(items: DataFrame, percent: int) -> DataFrame:
    """``(item_id, width, g, part, size)``: per size partition the ``m`` smallest hashes of each item.

    The ranks are taken inside one item, whose grams are bounded by the length of one text.
    """
    size = items.groupBy("item_id").agg(F.count("*").alias("size")).withColumn("part", F.length(F.bin("size")))
    largest = size.groupBy("part").agg(F.max("size").alias("q"))
    m = largest.select("part", (F.col("q") - F.ceil(F.col("q") * percent / 100) + 1).alias("m"))
    lists = items.groupBy("item_id", "width").agg(F.array_sort(F.collect_list("g")).alias("all"))
    return lists.join(size, "item_id").join(m, "part") \
        .select("item_id", "width", "part", "size", F.explode(F.slice("all", F.lit(1), F.col("m").cast("int"))).alias("g"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)``: the benchmark items that each document contains."""
    items = stored(_item_grams(benchmark, k), "items")
    marks = stored(signatures(items, percent), "signatures")
    limits = {r["width"]: r["top"] for r in marks.groupBy("width").agg(F.max("g").alias("top")).collect()}  # at most k rows
    base = texts(docs).where("doc_id IS NOT NULL")

    def shown(rows: DataFrame, bound: bool) -> DataFrame:
        rows, out = rows.select("doc_id", tokens(F.col("text")).alias("w")), None
        for width, top in sorted(limits.items()):
            got = rows.select("doc_id", F.lit(width).alias("width"), F.explode(grams(F.col("w"), width)).alias("g")).where("g IS NOT NULL")
            got = got.where(F.col("g") <= top) if bound else got
            out = got if out is None else out.unionByName(got)
        return out
    if not limits:
        return base.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).cast("bigint").alias("n_shared"), F.lit(0).cast("bigint").alias("n_item")).limit(0)
    probe = marks.select("width", "g").distinct()
    found = stored(shown(base, True).join(probe, ["width", "g"]).distinct(), "hits")
    candidates = found.join(marks.select("item_id", "width", "g"), ["width", "g"]).select("doc_id", "item_id").distinct()
    candidates = stored(candidates, "candidates")
    inside = shown(only(base, candidates.select("doc_id")), False) \
        .join(items.select("width", "g").distinct(), ["width", "g"], "left_semi").distinct()
    size = items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return inside.join(items, ["width", "g"]).join(candidates, ["doc_id", "item_id"]).groupBy("doc_id", "item_id") \
        .agg(F.count("*").alias("n_shared")).join(size, "item_id").where(F.col("n_shared") * 100 >= F.col("n_item") * percent) \
        .select("doc_id", "item_id", "n_shared", "n_item")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document contains no benchmark item."""
    return without(docs, leaks(docs, benchmark, k=k, percent=percent).select("doc_id"))

"""Jaccard join of word n-gram sets by size-aware light and heavy parts; its groups; near-copy removal.

Two texts link when ``100 * |A & B| >= percent * |A | B|``.  A set of size ``n`` that links may miss at most
``d(n) = n - ceil(percent * n / 100)`` of its own grams, so under any one order of all grams

* the first ``d + 1`` grams of two linked sets share a gram: the *inverted lists* of the heavy (large) sets;
* the first ``d + 2`` grams share two grams: the *2-subsets* that light (small) sets enumerate.

All subsets of overlap size, which plain overlap joins enumerate, are astronomically many at high
similarity; 2-subsets of the prefix keep the idea and lose nothing.  A light set pays ``(d+1)(d+2)/2`` rows
instead of ``d + 1`` rows plus the false partners in their lists; the boundary is the size at which the
measured mean list makes both equal.  Light sets large enough to link with a heavy one write both.

Grams are ordered by hash, with those in more than ``hot`` lists last, so that passages shared by many
documents do not become lists.  Which grams count as hot changes the cost only, never the result.

Lists are divided by set size, and a set enters only the divisions where the place of the gram in its prefix
still allows a link.  Pairs that meet are compared on their prefixes, and those left on their whole sets.

Equal sets are one class from the start.  Within a list, members are first compared with one hub, then in
several rounds with a few others of small random parts of it; lists whose members are all in one group are done.  The
remaining pairs of different groups are then all compared, in blocks, so no link between different texts is lost
and no pairs inside a group are made.  A pair comes out of the list of its first common grams, not of all.

Null, empty and blank texts have an empty set and are linked with nothing.  Rows that repeat an
id are one document with several texts: each has its own set size, and all their links count for the id.
Rows with a null id are left out, as a class is named by ids.  Columns but id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wideloom.llm.common import coded, components, free, hashes, map_rows, mix, only, stored, texts, without, words

HOT_LIST = 8             # a gram in more lists goes last in the order
HOT_GRAMS = 1_000_000    # bound on the broadcast hot grams (8 MB); the limit above rises to keep it
PAIRS_PER_ROW = 4        # remaining pairs per list row at which the exact last step starts
HUB_ROUNDS = 2           # the first with hubs, the others with parts of lists
SIZE_STEP = 1.03         # ratio of the sizes in neighbouring buckets
SKETCH = 8               # integers of a parity sketch
FIRST_GRAMS = 24         # prefix grams at hand where pairs are made, to tell the first common ones
BLOCK = 512              # members of a list on one side of a block of pairs
SALT_ROWS = 2_000        # partners of one hub per salt
FEW = 4                  # pairs of a set that a round compares
NEAR = 16                # members of a part of a list in a round
PASSES = 2               # parts in which lists and large sets of pairs are worked off, as less is on disk at once
PASS_PAIRS = 5_000


def gram_sets(items: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word grams of each text (short texts: all words as one)."""
    codes, sizes, distinct = coded([words(t) for t in items])
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = h
    for i in range(1, k):
        rolled = mix(rolled[:len(h) - i] if len(h) > i else h[:0], h[i:])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            got = np.unique(rolled[at:at + n - k + 1])
        elif n:
            got = np.array([reduce(lambda a, b: mix(a, b), (h[i:i + 1] for i in range(at, at + n)))[0] ^ np.uint64(n)], np.uint64)
        else:
            got = h[:0]
        out.append(got.view(np.int64))
        at += n
    return [np.sort(x) for x in out]


def slack(n: int, percent: int) -> int:
    return n - -(-n * percent // 100)


def prefix(grams: np.ndarray, size: int, hot: np.ndarray) -> np.ndarray:
    """The first ``size`` grams in the common order: not hot first, then by hash."""
    if not len(hot) or not len(grams):
        return grams[:size]
    last = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
    cold = grams[~last]
    return cold[:size] if len(cold) >= size else np.concatenate([cold, grams[last][:size - len(cold)]])


def parity(grams: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of grams falls in each of ``64 * SKETCH`` buckets, as bits of integers.

    The bits in which two sets differ are at most as many as the grams in which they differ.
    """
    odd = np.bincount((grams.view(np.uint64) >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(docs: DataFrame, k: int, percent: int, hot: np.ndarray, wide: bool) -> DataFrame:
    """``(doc_id, n, digest, prefix, sketch)``; ``wide`` lengthens the prefix, to see what would come next."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(c):
        sets = gram_sets(c["text"], k)
        size = [5 * slack(len(g), percent) // 4 + 4 if wide else slack(len(g), percent) + 2 for g in sets]
        heads = [prefix(g, s, shared.value) if 100 * (len(g) - 1) >= percent * len(g) or 100 * len(g) >= percent * (len(g) + 1) else g[:0]
                 for g, s in zip(sets, size)]
        yield pa.RecordBatch.from_arrays([
            pa.array(c["doc_id"], pa.int64()), pa.array([len(g) for g in sets], pa.int32()),
            pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary()), pa.array(heads, pa.list_(pa.int64())),
            pa.array([None if wide or not len(h) else parity(g) for g, h in zip(sets, heads)], pa.list_(pa.int64()))], ["doc_id", "n", "digest", "prefix", "sketch"])
    return map_rows(docs, run, "doc_id bigint, n int, digest binary, prefix array<bigint>, sketch array<bigint>")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct non-empty set, named by its smallest id."""
    return rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))


def hot_grams(lists: DataFrame, hot: int, bound: int = HOT_GRAMS) -> tuple[np.ndarray, float]:
    """From ``lists(g)`` the grams in more than ``hot`` lists (a higher limit if they were over ``bound``), and the mean list of the others."""
    counts = stored(lists.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "grams")
    sizes = sorted((r["c"], r["k"]) for r in counts.groupBy(F.least("c", F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("k")).collect())
    total, limit = 0, 1 << 20
    for c, k in reversed(sizes):
        if c <= hot or total + k > bound:
            break
        total, limit = total + k, c - 1
    limit = max(limit, hot)
    found = counts.where(F.col("c") > limit).select("g").toPandas()["g"].to_numpy(np.int64) if total else np.zeros(0, np.int64)
    cold = [(c, k) for c, k in sizes if c <= limit]
    rows = sum(c * k for c, k in cold)
    free(counts)
    return np.sort(found), sum(c * c * k for c, k in cold) / rows if rows else 1.0


def boundary(mean_list: float, percent: int) -> int:
    """Largest size whose 2-subsets cost no more than the lists: ``(d + 2) / 2 <= mean list``."""
    n = 0
    while (slack(n + 1, percent) + 2) / 2 <= max(mean_list, 1.5) and n < 100_000:
        n += 1
    return n


def _keys(classes: DataFrame, light: int, percent: int) -> DataFrame:
    """``(key, pos, rep, n)``: 2-subsets of light sets, single grams of heavy sets and of the light ones next to them.

    ``pos`` says that a set whose first shared key is here has at most ``n - pos + 1`` grams in common: the
    place of a gram in the prefix, or for two grams the place of the second less one.
    """
    d = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int")
    none = F.array().cast("array<struct<key:bigint,pos:int>>")
    entry = lambda key, pos: F.struct(key.alias("key"), pos.cast("int").alias("pos"))
    single = F.when(F.col("n") * 100 >= percent * (light + 1), F.transform(F.slice("prefix", F.lit(1), d + 1), lambda g, i: entry(g, i + 1))).otherwise(none)
    subsets = F.when((F.col("n") <= light) & (F.size("prefix") > 1), F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("prefix")),
        lambda j: F.transform(F.slice("prefix", F.lit(1), j - 1), lambda g: entry(F.xxhash64(g, F.element_at("prefix", j)), j - 1))))).otherwise(none)
    return classes.where("size(prefix) > 0").select("rep", "n", F.explode(F.concat(single, subsets)).alias("e")).select("e.key", "e.pos", "rep", "n")


def _bucket(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1.0))) / math.log(SIZE_STEP)).cast("int")


def _entries(postings: DataFrame, percent: int) -> DataFrame:
    """``(key, bucket, home, rep, n, pos)``: where a set waits for larger partners, and where it looks for smaller ones.

    A set at ``pos`` can only link with partners up to ``(n - pos + 1) * (100 + percent) / percent - n``.  It waits in
    the bucket of its own size if that allows partners at least as large, and looks into the buckets from the
    smallest possible partner up to that size: grams late in a prefix meet few sets or none.
    """
    most = F.least((F.col("n") - F.col("pos") + 1) * ((100 + percent) / percent) - F.col("n") + 1e-6, F.col("n").cast("double"))
    low, high, own = _bucket(F.col("n") * percent / 100 - 1e-6), _bucket(most), _bucket(F.col("n").cast("double"))
    waits = F.when(most >= F.col("n"), F.array(F.struct(own.alias("bucket"), F.lit(True).alias("home")))).otherwise(F.array().cast("array<struct<bucket:int,home:boolean>>"))
    looks = F.when((most >= F.col("n") * percent / 100 - 1e-6) & (high >= low), F.transform(F.sequence(low, high), lambda b: F.struct(b.alias("bucket"), F.lit(False).alias("home")))) \
        .otherwise(F.array().cast("array<struct<bucket:int,home:boolean>>"))
    return postings.select("key", "rep", "n", "pos", F.explode(F.concat(waits, looks)).alias("e")).select("key", "e.bucket", "e.home", "rep", "n", "pos")


def _shared_entries(keys: DataFrame, percent: int) -> DataFrame:
    """The entries of the lists in which a set waits and another one looks.  One shuffle by key serves both counts."""
    lists, parts = W.partitionBy("key"), W.partitionBy("key", "bucket")
    postings = keys.withColumn("c", F.count("*").over(lists)).where("c > 1")
    seen = _entries(postings, percent).select("*", F.max("home").over(parts).alias("waits"), F.min("home").over(parts).alias("looks"),
                                              F.min("rep").over(parts).alias("x"), F.max("rep").over(parts).alias("y"))
    return seen.where("waits AND NOT looks AND x < y").drop("waits", "looks", "x", "y")


def _close(na: Column, ia: Column, nb: Column, ib: Column, percent: int) -> Column:
    """Whether sets of these sizes that first meet at these places can reach the overlap."""
    return F.least(na - ia, nb - ib) + 1 >= F.ceil((na + nb) * percent / (100 + percent))


def _salted(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """``pairs`` with ``left`` and ``right`` from ``sets(rep, n, value)``.  Partners of one very common ``b`` are salted."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
    right = sets.join(parts, sets.rep == parts.b).select("b", "parts", F.col("n").alias("right_n"), F.col(value).alias("right"),
                                                         F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    wide = pairs.join(parts.where("parts > 1"), "b", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    left = wide.join(sets, wide.a == sets.rep).select("a", "b", "salt", F.col("n").alias("left_n"), F.col(value).alias("left"))
    return left.join(right.drop("parts"), ["b", "salt"])


def _overlap_needed(percent: int) -> Column:
    return F.ceil((F.col("left_n") + F.col("right_n")) * percent / (100 + percent))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough grams to reach the overlap.

    The prefix that ends first in the common order holds all of its matches up to there, so with ``m`` shared
    prefix grams the overlap is at most ``m`` and the rest of that set: ``m >= needed - n + prefix``.
    """
    both = F.size(F.array_intersect("left", "right"))
    rest = F.greatest(F.col("left_n") - F.size("left"), F.col("right_n") - F.size("right"))
    return _salted(pairs, classes, "prefix").where(both + rest >= _overlap_needed(percent)).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link."""
    both = F.size(F.array_intersect("left", "right"))
    return _salted(pairs, sets, "grams").where(100 * both >= percent * (F.col("left_n") + F.col("right_n") - both)).select("a", "b")


def jaccard_classes(docs: DataFrame, *, k: int = 5, percent: int = 80, hot: int = HOT_LIST) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row with an id: set size and smallest id reachable by links."""
    base = texts(docs).where("doc_id IS NOT NULL")
    none = np.zeros(0, np.int64)
    wide = _prefixes(base, k, percent, none, True)
    frequent, mean = hot_grams(wide.select(F.explode("prefix").alias("g")), hot)
    light = boundary(mean, percent)
    made = stored(_prefixes(base, k, percent, frequent, False), "prefixes")
    classes = stored(_classes(made), "classes")
    rows = stored(made.select("doc_id", "n", "digest"), "rows")
    free(made)
    members = rows.where("n > 0").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    keys = _keys(classes, light, percent)
    entries = [stored(_shared_entries(keys.where(F.pmod("key", F.lit(PASSES)) == i), percent), "entries") for i in range(PASSES)]
    links = _links(base, classes, entries, k, percent)
    label = components(links)
    of_class = classes.select("rep").join(label, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("label", "rep").alias("label"))
    named = members.join(of_class, "rep").groupBy("doc_id").agg(F.min("label").alias("component_id"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles")).join(named, "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(docs: DataFrame, classes: DataFrame, made: list[DataFrame], k: int, percent: int) -> DataFrame:
    """Verified links between classes, enough of them to connect every group."""
    def check(pairs: DataFrame) -> DataFrame:
        """Prefixes of the sets in a pair first; only sets in a pair that this leaves are made again from the texts and compared."""
        pairs = stored(pairs, "tried")
        heads = classes.select(F.col("rep").alias("doc_id"), "n", "prefix")
        heads = only(heads, pairs.select(F.explode(F.array("a", "b")))).withColumnRenamed("doc_id", "rep")
        able = stored(_possible(pairs, heads, percent), "pairs")
        free(pairs)
        passes, links = PASSES if able.count() > PASS_PAIRS else 1, []
        for i in range(passes):
            now = able.where(F.pmod(F.xxhash64("b"), F.lit(passes)) == i)
            wanted = only(docs, now.select(F.explode(F.array("a", "b"))))
            sets = stored(map_rows(wanted, lambda c: _set_batch(c["doc_id"], gram_sets(c["text"], k)), "rep bigint, n int, grams array<bigint>"), "sets")
            links.append(stored(_verified(now, sets, percent).distinct(), "links"))
            free(sets)
        free(able)
        return reduce(DataFrame.unionByName, links)

    entries = reduce(DataFrame.unionByName, made)
    open_lists, found, last = entries.withColumn("label", F.col("rep")), None, None
    for turn in range(HUB_ROUNDS):
        if turn:
            pairs = _near_pairs(open_lists, classes, percent, turn)
        else:
            hubs = open_lists.where("home").groupBy("key", "bucket").agg(F.min(F.struct(
                F.xxhash64("label"), F.col("rep").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"))).alias("h"))
            pairs = open_lists.join(hubs, ["key", "bucket"]).where(F.col("label") != F.col("h.hub_label")) \
                .where(_close(F.col("n"), F.col("pos"), F.col("h.hub_n"), F.col("h.hub_pos"), percent)).select(F.col("rep").alias("a"), F.col("h.hub").alias("b")).distinct()
        fresh = check(pairs)
        found = fresh if found is None else found.unionByName(fresh)
        label = components(found)
        labelled = entries.join(label, F.col("rep") == F.col("node"), "left").select("key", "bucket", "home", "rep", "n", "pos", F.coalesce("label", "rep").alias("label"))
        waiting, looking = F.sum(F.col("home").cast("double")), F.sum((~F.col("home")).cast("double"))
        groups = labelled.groupBy("key", "bucket", "label").agg(waiting.alias("w"), looking.alias("l")).groupBy("key", "bucket") \
            .agg(F.sum("w").alias("w"), F.sum("l").alias("l"), F.sum(F.col("w") * F.col("l")).alias("own")) \
            .select("key", "bucket", (F.col("w") + F.col("l")).alias("rows"), (F.col("w") * F.col("l") - F.col("own")).alias("cross")).where("cross > 0")
        left = stored(groups, "open")
        n, cross = left.agg(F.coalesce(F.sum("rows"), F.lit(0.0)), F.coalesce(F.sum("cross"), F.lit(0.0))).head()
        used, open_lists = open_lists, stored(labelled.join(left.select("key", "bucket", "rows"), ["key", "bucket"]), "openlists")
        free(left, *([used] if turn else []))
        if cross <= PAIRS_PER_ROW * n or last is not None and cross > 0.9 * last:
            break
        last = cross
    if n:
        found = found.unionByName(check(_cross_pairs(open_lists, classes, percent)))
    free(open_lists, *made)
    return found


def _set_batch(ids: list, sets: list[np.ndarray]) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(g) for g in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "n", "grams"])]


def _cross_pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All possible pairs of one list and different groups, each list cut into blocks of bounded size.

    It leaves a pair to an earlier list when the two prefixes have more than two grams in common up to the gram after
    the place of this one: their first common gram, or first two, have a list in which the pair also meets, as it
    allows larger partners.
    """
    blocked = _sketched(lists, classes, BLOCK, "rep")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = _side(blocked.where("home"), "a", F.col("mine").alias("x"), every.alias("y")), _side(blocked.where("NOT home"), "b", F.col("mine").alias("y"), every.alias("x"))
    return _met(left, right, percent, F.size(F.array_intersect("fa", "fb")) <= 2).distinct()


def _near_pairs(lists: DataFrame, classes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Possible pairs inside small random parts of the lists, other parts every turn; of every set those that meet most often."""
    parts = _sketched(lists, classes, NEAR, "rep", F.lit(turn)).withColumn("y", F.lit(0))
    left, right = (_side(parts.where(which), t, F.col("mine").alias("x"), F.col("y")) for which, t in (("home", "a"), ("NOT home", "b")))
    pairs = _met(left, right, percent, F.lit(True)).groupBy("a", "b").agg(F.count("*").alias("c"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("rank") <= FEW).select("a", "b")


def _sketched(lists: DataFrame, classes: DataFrame, size: int, *by) -> DataFrame:
    """The lists with the sketches and first grams of their sets; ``mine`` is one of ``blocks`` parts of about ``size`` members."""
    bits = classes.select(F.col("rep").alias("of"), F.slice("prefix", 1, FIRST_GRAMS).alias("first"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    return lists.join(bits, F.col("rep") == F.col("of")).withColumn("blocks", F.ceil(F.col("rows") / size).cast("int")).withColumn("mine", F.pmod(F.xxhash64(*by), F.col("blocks")).cast("int"))


def _side(rows: DataFrame, t: str, *places: Column) -> DataFrame:
    return rows.select("key", "bucket", F.col("rep").alias(t), F.col("n").alias("n" + t), F.col("pos").alias("i" + t), F.col("label").alias("l" + t),
                       F.slice("first", F.lit(1), F.col("pos") + 1).alias("f" + t), *[F.col(f"s{i}").alias(f"{t}{i}") for i in range(SKETCH)], *places)


def _met(left: DataFrame, right: DataFrame, percent: int, also: Column) -> DataFrame:
    """Pairs of different groups that meet in a part.  The join's own condition compares sizes, places and parity
    sketches: sets that link differ in at most ``(100 - percent) / (100 + percent)`` of the sum of their sizes.
    """
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH)), F.lit(0))
    return left.join(right, (left.key == right.key) & (left.bucket == right.bucket) & (left.x == right.x) & (left.y == right.y) & (F.col("la") != F.col("lb")) & (F.col("na") <= F.col("nb"))
                     & _close(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"), percent) & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)) & also) \
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def drop_near_copies(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those of any document that is not the smallest id of its group.

    Rows with a null id stay.  Rows that repeat an id are kept once.
    """
    classes = stored(jaccard_classes(docs, k=k, percent=percent), "classes")
    kept = without(docs, classes.where("component_id < doc_id").select("doc_id"))
    if classes.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(kept.where(F.col("doc_id").isNull()))

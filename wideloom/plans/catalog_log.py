"""Queries: experiment log, similarity search and run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideloom.operators import cleaning, runlog, similarity, textsearch
from wideloom.plans import flow
from wideloom.plans.catalog_profile import _scratch
from wideloom.plans.inputs import LOG, RUNS
from wideloom.plans.registry import query, rounded, table, union_sql

_LATEST = f"""v AS ({LOG.sql}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp DESC, event_id DESC) AS k FROM v),
l AS (SELECT * FROM r WHERE k = 1)"""


@query("log_latest", f"WITH {_LATEST} SELECT id, event_id, payload FROM l")
def log_latest(spark, d):
    return runlog.latest(LOG.frame(spark, d), "id", "timestamp", "event_id").select("id", "event_id", "payload")


@query("log_query", f"SELECT id, event_id, payload FROM ({LOG.sql}) v WHERE table_name = 'purchase' AND project_id = 'p3' ORDER BY timestamp DESC, id DESC LIMIT 20")
def log_query(spark, d):
    return runlog.query(LOG.frame(spark, d), "purchase", project_id="p3", limit=20).select("id", "event_id", "payload")


@query("log_query_agent", f"SELECT id, event_id, payload FROM ({LOG.sql}) v WHERE table_name = 'click' AND source_agent = 'a1'")
def log_query_agent(spark, d):
    return runlog.query(LOG.frame(spark, d), "click", source_agent="a1").select("id", "event_id", "payload")


@query("log_json_filter", f"SELECT id, event_id FROM ({LOG.sql}) v WHERE table_name = 'view' AND CAST(json_extract(payload, '$.k') AS INTEGER) IN (5, 7, 69)")
def log_json_filter(spark, d):
    return runlog.query(LOG.frame(spark, d), "view", filters={"k": [5, 7, 69]}).select("id", "event_id")


@query("log_json_filter_limited", f"SELECT id, event_id FROM (SELECT * FROM ({LOG.sql}) v WHERE table_name = 'view' ORDER BY timestamp DESC, id DESC LIMIT 500) t "
       "WHERE CAST(json_extract(payload, '$.k') AS INTEGER) = 7")
def log_json_filter_limited(spark, d):
    return runlog.query(LOG.frame(spark, d), "view", filters={"k": 7}, limit=500).select("id", "event_id")


@query("log_json_filter_then_limit", f"SELECT id, event_id FROM ({LOG.sql}) v WHERE table_name = 'view' AND CAST(json_extract(payload, '$.k') AS INTEGER) = 7 "
       "ORDER BY timestamp DESC, id DESC LIMIT 3")
def log_json_filter_then_limit(spark, d):
    return runlog.query(LOG.frame(spark, d), "view", filters={"k": 7}, limit=3, limit_after_filter=True).select("id", "event_id")


@query("log_get", f"WITH {_LATEST} SELECT id, event_id FROM l WHERE id = 'e123' AND NOT deleted")
def log_get(spark, d):
    return runlog.get(LOG.frame(spark, d), "e123").select("id", "event_id")


@query("log_live", f"WITH {_LATEST} SELECT id, event_id FROM l WHERE NOT deleted")
def log_live(spark, d):
    newest = runlog.latest(LOG.frame(spark, d), "id", "timestamp", "event_id")
    return newest.where("NOT deleted").select("id", "event_id")


@query("log_delete", f"SELECT id, event_id FROM ({LOG.sql}) v WHERE id NOT IN (SELECT id FROM ({LOG.sql}) w WHERE deleted)")
def log_delete(spark, d):
    log = LOG.frame(spark, d)
    return runlog.without(log, log.where("deleted")).select("id", "event_id")


@query("log_tombstones", f"WITH {_LATEST} SELECT id, true AS deleted FROM l WHERE id IN ('e1', 'e2', 'e3', 'nowhere') AND NOT deleted")
def log_tombstones(spark, d):
    return runlog.tombstones(LOG.frame(spark, d), ["e1", "e2", "e3", "nowhere"]).select("id", "deleted")


@query("log_stats", f"SELECT table_name, count(*) AS entries, CAST(strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS earliest, "
       f"CAST(strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS latest FROM ({LOG.sql}) v GROUP BY table_name")
def log_stats(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return runlog.table_stats(LOG.frame(spark, d)).select("table_name", "entries", day("earliest"), day("latest"))


@query("log_memory_stats", f"SELECT n AS table_name, (SELECT count(*) FROM ({LOG.sql}) v WHERE table_name = n) AS entries FROM (VALUES ('click'), ('view'), ('unused')) t(n) "
       "UNION ALL SELECT 'text_entries', count(*) FROM embeddings")
def log_memory_stats(spark, d):
    return runlog.memory_stats(LOG.frame(spark, d), table(spark, d, "embeddings"), ["click", "view", "unused"])


@query("log_phase_tables", f"SELECT id, event_id, CASE table_name WHEN 'click' THEN 'ingestion_results' WHEN 'view' THEN 'cleaning_results' ELSE 'reports' END AS table_name "
       f"FROM ({LOG.sql}) v WHERE table_name <> 'error'")
def log_phase_tables(spark, d):
    """Written to disk by phase table and read back through the partition filter."""
    phase = F.when(F.col("table_name") == "click", "ingestion_results").when(F.col("table_name") == "view", "cleaning_results") \
        .when(F.col("table_name") == "error", "phase_executions").otherwise("reports")
    log = LOG.frame(spark, d).withColumn("table_name", phase)
    path = _scratch(spark, "log")
    runlog.append(log, path)
    return spark.read.parquet(path).where(F.col("table_name").isin(*runlog.PHASE_TABLES) & (F.col("table_name") != "phase_executions")) \
        .select("id", "event_id", "table_name")


@query("feature_outcomes", f"SELECT CASE WHEN value > 50 THEN 'successful_feature' ELSE 'failed_feature' END AS tag, count(*) AS cnt FROM events GROUP BY 1")
def feature_outcomes(spark, d):
    tag = runlog.outcome_tag(F.col("value") - 50)
    return table(spark, d, "events").groupBy(tag.alias("tag")).agg(F.count("*").alias("cnt"))


# Similarity ------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5)"


def _query_vector(df):
    return df.where("vec_id = 0").select("embedding").head()[0]


@query("similar_topk", f"SELECT vec_id, score FROM (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) t ORDER BY score DESC, vec_id LIMIT 5")
def similar_topk(spark, d):
    df = table(spark, d, "embeddings")
    return rounded(similarity.search(df, _query_vector(df), 5, key="vec_id").select("vec_id", "score"), 5, "score")


@query("similar_topk_filtered", f"SELECT vec_id, score FROM (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 2)) t ORDER BY score DESC, vec_id LIMIT 5")
def similar_topk_filtered(spark, d):
    df = table(spark, d, "embeddings")
    return rounded(similarity.search(df, _query_vector(df), 5, key="vec_id", where=F.col("label").isin(1, 2)).select("vec_id", "score"), 5, "score")


@query("similar_topk_tags", f"SELECT vec_id, score FROM (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20) t WHERE label IN (2, 3)")
def similar_topk_tags(spark, d):
    df = table(spark, d, "embeddings").withColumn("tags", F.array(F.concat(F.lit("t"), F.col("label"))))
    return rounded(similarity.search(df, _query_vector(df), 20, key="vec_id", tags=["t2", "t3"]).select("vec_id", "score"), 5, "score")


_ALL_PAIRS = """SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS rank
 FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id) t WHERE rank <= 5"""


@query("similar_all", _ALL_PAIRS)
def similar_all(spark, d):
    return _all(table(spark, d, "embeddings"))


def _all(df, **kw):
    queries = df.withColumnRenamed("vec_id", "query_id")
    return similarity.nearest(queries, df.withColumnRenamed("vec_id", "id"), 5, exclude_self=True, **kw).select("query_id", "id", "rank")


@query("similar_all_grid", _ALL_PAIRS)
def similar_all_grid(spark, d):
    """The same through cells, as for query sets too large to broadcast."""
    return _all(table(spark, d, "embeddings"), broadcast_bytes=0, block_rows=200)


_VOTES = """WITH n AS (SELECT q.vec_id AS query_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY
 round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 10), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id),
c AS (SELECT query_id, label, count(*) AS votes FROM n WHERE rank <= 5 GROUP BY query_id, label)
SELECT query_id, prediction, votes FROM (SELECT query_id, label AS prediction, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS k FROM c) t WHERE k = 1"""


@query("knn_vote", _VOTES)
def knn_vote(spark, d):
    df = table(spark, d, "embeddings")
    return similarity.knn_vote(df.withColumnRenamed("vec_id", "query_id"), df.withColumnRenamed("vec_id", "id"), "label", exclude_self=True)


@query("knn_vote_cells", _VOTES)
def knn_vote_cells(spark, d):
    """The same vote through cells."""
    df = table(spark, d, "embeddings")
    return similarity.knn_vote(df.withColumnRenamed("vec_id", "query_id"), df.withColumnRenamed("vec_id", "id"), "label", exclude_self=True,
                               broadcast_bytes=0, block_rows=200)


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query("similar_text", f"""
WITH c AS (SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id, unnest({_WORDS}) AS term FROM documents) t GROUP BY ALL),
i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY term),
w AS (SELECT id, term, (1 + ln(n)) * idf AS raw FROM c JOIN i USING (term)),
d AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM w),
qc AS (SELECT id, term, count(*) AS n FROM (SELECT item_id AS id, unnest({_WORDS}) AS term FROM benchmark) t GROUP BY ALL),
qw AS (SELECT id, term, (1 + ln(n)) * idf AS raw FROM qc JOIN i USING (term)),
q AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM qw),
s AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.weight * d.weight), 9) AS score FROM q JOIN d USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) t WHERE rank <= 5""")
def similar_text(spark, d):
    """The five documents nearest to the text of every benchmark item."""
    index = textsearch.build(table(spark, d, "documents"), "doc_id", "text")
    found = textsearch.search(index, table(spark, d, "benchmark"), 5, key="item_id", text="text").withColumnRenamed("id", "doc_id")
    return rounded(found, 6, "score")


@query("canned_search", f"SELECT vec_id FROM (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 5) t WHERE label % 2 = 0")
def canned_search(spark, d):
    tags = F.when(F.col("label") % 2 == 0, F.array(F.lit("model_performance"))).otherwise(F.array(F.lit("dataset_profile")))
    df = table(spark, d, "embeddings").withColumns({"tags": tags, "id": F.col("vec_id")})
    return runlog.canned_search(df, "best_models", _query_vector(df)).select("vec_id")


@query("collection_size", "SELECT count(*) AS entries FROM embeddings")
def collection_size(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("entries"))


@query("collection_clear", "SELECT vec_id AS id FROM embeddings WHERE label < 5")
def collection_clear(spark, d):
    """A collection that is filled, cleared and filled again with a part."""
    path, schema = _scratch(spark, "collection"), "id bigint, label int, embedding array<float>"
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    rows.write.mode("append").parquet(path)
    runlog.clear(spark, path, schema)
    rows.where("label < 5").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).select("id")


# Run log ---------------------------------------------------------------------------------------

@query("run_progress", f"SELECT session, count(DISTINCT CASE WHEN success THEN phase END) AS completed, count(DISTINCT CASE WHEN success THEN phase END) * 100.0 / 8 AS progress_pct, "
       f"count(DISTINCT CASE WHEN NOT success THEN phase END) AS failed FROM ({RUNS.sql}) v GROUP BY session")
def run_progress(spark, d):
    return runlog.progress(RUNS.frame(spark, d)).withColumn("failed", F.size("failed"))


@query("run_elapsed", f"SELECT session, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) AS seconds FROM ({RUNS.sql}) v GROUP BY session")
def run_elapsed(spark, d):
    return rounded(runlog.elapsed(RUNS.frame(spark, d)), 3, "seconds")


@query("missing_prereqs", f"WITH v AS ({RUNS.sql}), s AS (SELECT DISTINCT session FROM v), n AS (SELECT * FROM (VALUES ('ingestion'), ('profiling'), ('cleaning'), ('selection'), ('features')) t(phase)) "
       "SELECT session, phase FROM s, n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.session = s.session AND v.phase = n.phase AND v.success)")
def missing_prereqs(spark, d):
    return runlog.missing_prerequisites(RUNS.frame(spark, d), "modeling")


@query("completion_summary", f"SELECT session, completed, completed * 100.0 / 8 AS progress_pct, failed_phases, seconds, completed >= 8 AS finished FROM ("
       f"SELECT session, count(DISTINCT CASE WHEN success THEN phase END) AS completed, count(DISTINCT CASE WHEN NOT success THEN phase END) AS failed_phases, "
       f"round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) AS seconds FROM ({RUNS.sql}) v GROUP BY session) t")
def completion_summary(spark, d):
    return rounded(runlog.completion_summary(RUNS.frame(spark, d)), 3, "seconds")


@query("common_ops", "SELECT event_type AS \"column\", CASE WHEN value > 50 THEN 'handle_outliers' ELSE 'impute_numeric' END AS op_type, count(*) AS uses FROM events GROUP BY 1, 2")
def common_ops(spark, d):
    op = F.when(F.col("value") > 50, "handle_outliers").otherwise("impute_numeric")
    return runlog.common_ops(table(spark, d, "events").select(F.col("event_type").alias("column"), op.alias("op_type")))


@query("common_ops_of_plans", "SELECT 'qty' AS \"column\", 'impute_numeric' AS op_type, count(*) AS uses FROM (" + union_sql(
    f"SELECT count(*) FILTER (l_orderkey % {rest} = 0) * 1.0 / count(*) AS missing FROM lineitem" for rest in (5, 7)) + ") t WHERE missing > 0 AND missing <= 0.5 HAVING count(*) > 0")
def common_ops_of_plans(spark, d):
    """Plans of two deliveries of lineitem, stored and counted."""
    li = table(spark, d, "lineitem")
    plans = None
    for rest in (5, 7):
        df = li.select(F.when(F.col("l_orderkey") % rest != 0, F.col("l_quantity")).alias("qty"))
        plan = cleaning.plan_frame(df, [o for o in cleaning.plan_cleaning(df) if o.op_type == "impute_numeric"])
        plans = plan if plans is None else plans.unionByName(plan)
    return runlog.common_ops(plans)


@query("stage_snapshots", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def stage_snapshots(spark, d):
    """Three saved stages, rolled back to the second one."""
    stages = flow.Stages(spark, _scratch(spark, "stages"), "r1")
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    stages.save("ingestion", df)
    stages.save("cleaning", df.where("o_totalprice > 1000"))
    stages.save("features", df.where("o_totalprice > 200000"))
    stages.rollback("cleaning")
    return stages.load(stages.last_stage())


@query("runs_with_schema", "SELECT 'supplier' AS name, count(*) AS n_rows FROM supplier")
def runs_with_schema(spark, d):
    from wideloom.sources import store
    base = _scratch(spark, "catalogue")
    for t in ("supplier", "nation"):
        store.store_table(table(spark, d, t), base, t, project_id="p1")
    found = store.catalogue(runlog.read_log(spark, f"{base}/log"))
    return runlog.runs_with_schema(found, table(spark, d, "supplier")).select("name", "n_rows")

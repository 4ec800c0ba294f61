"""Experiment log: an append-only table with JSON payloads, plus views over it."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from wideloom.operators.similarity import search

# Names of the log tables and tags.
PHASE_TABLES = ("ingestion_results", "cleaning_results", "feature_selection", "feature_engineering",
                "modeling_sessions", "evaluation_results", "reports", "phase_executions", "pipeline_completions")
MAIN_TABLES = ("past_projects", "user_preferences", "feature_history", "model_performance")
LOG_SCHEMA = ("id string, table_name string, project_id string, source_agent string, timestamp timestamp, "
              "payload string, deleted boolean")
TEXT_SCHEMA = ("id string, content string, tags array<string>, source_agent string, project_id string, "
               "timestamp timestamp, metadata map<string,string>, embedding array<float>")
PRESET_TAGS = {
    "similar_datasets": ("dataset_profile",),
    "successful_features": ("feature_engineering", "successful_feature"),
    "best_models": ("model_performance",),
}


def log_rows(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """Log rows from plain records; ``payload`` may be any JSON-able value."""
    return spark.createDataFrame(
        [(r["id"], r["table_name"], r.get("project_id"), r.get("source_agent"), r["timestamp"],
          json.dumps(r.get("payload", {}), default=str), bool(r.get("deleted", False))) for r in rows], LOG_SCHEMA)


def append(rows: DataFrame, path: str) -> None:
    """Append to the log; one folder per ``table_name`` so that reads prune to their table."""
    rows.write.mode("append").partitionBy("table_name").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def latest(log: DataFrame, key: str = "id", order: str = "timestamp", *ties: str) -> DataFrame:
    """Last version of every id.  Each map task keeps one row per id before the shuffle."""
    newest = W.partitionBy(key).orderBy(F.desc(order), *[F.desc(t) for t in ties])
    return log.withColumn("_v", F.row_number().over(newest)).where("_v = 1").drop("_v")


def live(log: DataFrame) -> DataFrame:
    """Latest versions without the deleted ones."""
    return latest(log).where(~F.coalesce(F.col("deleted"), F.lit(False)))


def matches(payload: str, filters: Mapping[str, object]) -> Column:
    """Every key must exist and equal the value, or be one of the values of a list.

    Numbers compare by value (5 equals 5.0), None equals a JSON null, and a key is a name, never a path.
    """
    ok, fields = F.lit(True), F.from_json(payload, "map<string,string>")
    for key, wanted in filters.items():
        value, there = F.element_at(fields, F.lit(key)), F.array_contains(F.map_keys(fields), key)
        options = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        hit = F.lit(False)
        for o in options:
            if o is None:
                hit = hit | value.isNull()
            elif isinstance(o, (int, float)) and not isinstance(o, bool):
                hit = hit | (value.try_cast("double") == float(o))
            else:
                hit = hit | (value == _json_text(o))
        ok = ok & F.coalesce(there & hit, F.lit(False))
    return ok


def _json_text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def query(log: DataFrame, table_name: str | None = None, *, project_id: str | None = None, source_agent: str | None = None,
          filters: Mapping[str, object] | None = None, limit: int | None = None, limit_after_filter: bool = False) -> DataFrame:
    """Newest first.  The limit counts rows before the payload filter unless told otherwise."""
    found = log
    for name, value in (("table_name", table_name), ("project_id", project_id), ("source_agent", source_agent)):
        if value is not None:
            found = found.where(F.col(name) == value)
    payload = matches("payload", filters) if filters else None
    if payload is not None and limit_after_filter:
        found, payload = found.where(payload), None
    found = found.orderBy(F.desc("timestamp"), F.desc("id"))
    if limit is not None:
        found = found.limit(limit)
    return found if payload is None else found.where(payload)


def get(log: DataFrame, entry_id: str) -> DataFrame:
    """Point lookup; the id filter reaches the scan."""
    return live(log.where(F.col("id") == entry_id))


def tombstones(log: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows that delete ``ids``; only ids that are live produce a row, so counting them tells
    what was deleted."""
    return live(log.where(F.col("id").isin(list(ids)))).withColumns({
        "deleted": F.lit(True), "timestamp": F.col("timestamp") + F.expr("INTERVAL 1 MICROSECOND"), "payload": F.lit("{}")})


def clear(spark: SparkSession, path: str, schema: str = TEXT_SCHEMA) -> None:
    """Empty a stored collection; later appends and reads find it as a table without rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def without(log: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Log without the entries listed in ``removed``."""
    return log.join(removed.select(key).distinct(), key, "left_anti")


def table_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("table_name").agg(
        F.count("*").alias("entries"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))


def memory_stats(log: DataFrame, texts: DataFrame | None = None, names: Sequence[str] = MAIN_TABLES) -> DataFrame:
    """Entry counts of the main tables (0 when missing) and of the text collection."""
    spark = log.sparkSession
    listed = spark.createDataFrame([(n,) for n in names], "table_name string")
    counts = listed.join(log.where(F.col("table_name").isin(list(names))).groupBy("table_name").agg(F.count("*").alias("entries")),
                         "table_name", "left").select("table_name", F.coalesce("entries", F.lit(0)).alias("entries"))
    if texts is None:
        return counts
    return counts.unionByName(texts.agg(F.count("*").alias("entries")).select(F.lit("text_entries").alias("table_name"), "entries"))


def outcome_tag(impact: Column) -> Column:
    """Tag of a tried feature: successful only when the measured change is positive."""
    return F.when(impact > 0, F.lit("successful_feature")).otherwise(F.lit("failed_feature"))


def text_rows(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    return spark.createDataFrame(
        [(r["id"], r["content"], list(r.get("tags", [])), r.get("source_agent"), r.get("project_id"), r["timestamp"],
          {k: str(v) for k, v in r.get("metadata", {}).items()}, r.get("embedding")) for r in rows], TEXT_SCHEMA)


def dataset_profile_entry(project: str, when, profile: Mapping) -> tuple[dict, dict]:
    """Structured and text row for a profiled data set."""
    text = ", ".join(f"{k} {v}" for k, v in profile.items())
    base = {"project_id": project, "source_agent": "profiling", "timestamp": when}
    return ({**base, "id": f"{project}-profile", "table_name": "past_projects", "payload": dict(profile)},
            {**base, "id": f"{project}-profile-text", "content": text, "tags": ["dataset_profile"], "metadata": profile})


def feature_entry(project: str, when, feature: str, impact: float) -> tuple[dict, dict]:
    tag = "successful_feature" if impact > 0 else "failed_feature"
    payload = {"feature": feature, "impact": impact, "outcome": tag}
    base = {"project_id": project, "source_agent": "features", "timestamp": when}
    return ({**base, "id": f"{project}-{feature}", "table_name": "feature_history", "payload": payload},
            {**base, "id": f"{project}-{feature}-text", "content": f"feature {feature} impact {impact}",
             "tags": ["feature_engineering", tag], "metadata": payload})


def model_entry(project: str, when, model: str, metrics: Mapping[str, float]) -> tuple[dict, dict]:
    payload = {"model": model, **metrics}
    base = {"project_id": project, "source_agent": "modeling", "timestamp": when}
    text = f"model {model} " + " ".join(f"{k} {v:.4f}" for k, v in metrics.items())
    return ({**base, "id": f"{project}-{model}", "table_name": "model_performance", "payload": payload},
            {**base, "id": f"{project}-{model}-text", "content": text, "tags": ["model_performance"], "metadata": payload})


def canned_search(texts: DataFrame, kind: str, query_vector: Sequence[float], k: int = 5) -> DataFrame:
    """Preset searches: similar data sets, tried features, past models (any-tag match)."""
    return search(texts, query_vector, k, tags=PRESET_TAGS[kind])


def common_ops(plans: DataFrame) -> DataFrame:
    """How often each cleaning operation was used per column name, over stored plans."""
    return plans.groupBy("column", "op_type").agg(F.count("*").alias("uses"))


def runs_with_schema(catalog: DataFrame, df: DataFrame) -> DataFrame:
    """Catalogue rows of runs whose table had the same columns and types."""
    return catalog.where(F.col("schema_key") == schema_key(df))


def schema_key(df: DataFrame) -> str:
    return "|".join(sorted(f"{n}:{t}" for n, t in df.dtypes))


# Run log -------------------------------------------------------------------------------------

STAGES = ("ingestion", "profiling", "cleaning", "selection", "features", "modeling", "evaluation", "report")


def progress(log: DataFrame, total: int = len(STAGES)) -> DataFrame:
    """Per session: completed stages, share of all stages, failed stages."""
    return log.groupBy("session").agg(
        F.count_distinct(F.when(F.col("success"), F.col("phase"))).alias("completed"),
        F.array_sort(F.collect_set(F.when(~F.col("success"), F.col("phase")))).alias("failed"),
    ).select("session", "completed", (F.col("completed") * 100.0 / total).alias("progress_pct"), "failed")


def elapsed(log: DataFrame) -> DataFrame:
    """Seconds between the first and the last log row of a session."""
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return log.groupBy("session").agg((seconds / 1e6).alias("seconds"))


def missing_prerequisites(log: DataFrame, stage: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """``(session, phase)`` for every earlier stage a session has not completed."""
    needed = list(stages[: list(stages).index(stage)])
    done = log.groupBy("session").agg(
        F.collect_set(F.when(F.col("success") & F.col("phase").isin(needed), F.col("phase"))).alias("done"))
    return done.select("session", F.explode(F.array_except(F.array(*[F.lit(n) for n in needed]), "done")).alias("phase"))


def completion_summary(log: DataFrame, total: int = len(STAGES)) -> DataFrame:
    return progress(log, total).join(elapsed(log), "session").select(
        "session", "completed", "progress_pct", F.size("failed").alias("failed_phases"), "seconds",
        (F.col("completed") >= total).alias("finished"))

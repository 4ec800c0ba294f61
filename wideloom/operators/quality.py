"""Validation checks, quality issues and profile advice as rule rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wideloom.functions.columns import col, families
from wideloom.functions.rules import Rule, fired
from wideloom.operators.counts import distinct_counts, duplicate_rows, value_counts
from wideloom.operators.profile import HIGH_NULL_PCT, TableFacts, memory_bytes, present

MIN_ROWS = 10
MIN_COLUMNS = 2
MAX_TARGET_NULL_PCT = 95.0
OVERALL_NULL_WARN_PCT = 80.0
IMBALANCE_RATIO = 10.0
TARGET_NULL_WARN_PCT = 10.0
LARGE_TABLE_MB = 1024.0


def ingest_validation(df: DataFrame, target: str | None = None) -> DataFrame:
    """``(check, level, passed, detail)`` from one aggregation."""
    names = df.columns
    wide = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    n = F.col("n").cast("double")
    filled = [F.col(f"c{i}") for i in range(len(names))]
    empty = sum((F.when(c == 0, 1).otherwise(0) for c in filled), F.lit(0))
    overall = F.coalesce(F.try_divide((n * len(names) - sum(filled, F.lit(0))) * 100, n * len(names)), F.lit(0.0))
    checks = [
        ("min_rows", "error", F.col("n") >= MIN_ROWS, n),
        ("min_columns", "error", F.lit(len(names) >= MIN_COLUMNS), F.lit(float(len(names)))),
        ("empty_columns", "warning", empty == 0, empty.cast("double")),
        ("overall_nulls", "warning", overall <= OVERALL_NULL_WARN_PCT, overall),
    ]
    if target is not None:
        present = target in names
        checks.append(("target_present", "error", F.lit(present), F.lit(float(present))))
        if present:
            t = F.col(f"c{names.index(target)}")
            pct = F.coalesce(F.try_divide((n - t) * 100, n), F.lit(0.0))
            checks.append(("target_has_values", "error", t > 0, t.cast("double")))
            checks.append(("target_null_share", "error", pct <= MAX_TARGET_NULL_PCT, pct))
    rows = [F.struct(F.lit(c).alias("check"), F.lit(lv).alias("level"), p.alias("passed"), d.cast("double").alias("detail"))
            for c, lv, p, d in checks]
    return wide.select(F.inline(F.array(*rows)))


def stage_preconditions(df: DataFrame, target: str | None = None) -> DataFrame:
    """Whether the table may enter each stage; looks at no more than 50 rows."""
    seen = df.limit(50).agg(F.count("*").alias("seen"))
    two = len(df.columns) >= 2
    has_target = target is not None and target in df.columns
    rows = [
        ("profiling", F.col("seen") > 0), ("cleaning", F.col("seen") > 0),
        ("selection", (F.col("seen") > 0) & F.lit(two)), ("features", F.col("seen") > 0),
        ("modeling", (F.col("seen") >= 50) & F.lit(has_target)), ("evaluation", F.lit(has_target)),
        ("report", F.col("seen") > 0),
    ]
    return seen.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), ok.alias("ready")) for s, ok in rows])))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """The two largest classes of the target, their ratio and whether it exceeds 10."""
    top = value_counts(df, [target]).orderBy(F.desc("cnt"), "value").limit(2)
    return (
        top.agg(F.max("cnt").alias("largest"), F.min("cnt").alias("second"), F.count("*").alias("k"))
        .select("largest", "second", (F.col("largest") / F.col("second")).alias("ratio"),
                ((F.col("k") > 1) & (F.col("largest") / F.col("second") > IMBALANCE_RATIO)).alias("imbalanced"))
    )


def quality_issues(df: DataFrame, target: str | None = None) -> DataFrame:
    """``(issue, column, value)``: null-heavy and constant columns, copies, target trouble, size.

    Everything but copies and classes comes from one aggregation.
    """
    names = df.columns
    distinct = distinct_counts(df)
    wide = df.agg(F.count("*").alias("n"), memory_bytes(df).alias("bytes"),
                  *[(F.count("*") - F.count(present(df, c))).alias(f"c{i}") for i, c in enumerate(names)])
    pct = [F.coalesce(F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")), F.lit(0.0)) for i in range(len(names))]
    megabytes = F.col("bytes") / 1048576.0
    found = [("high_null", c, pct[i] > HIGH_NULL_PCT, pct[i]) for i, c in enumerate(names)]
    found += [("constant", c, F.lit(True), F.lit(1.0)) for c in names if distinct.get(c, 2) <= 1]
    if target in names:
        i = names.index(target)
        found.append(("target_nulls", target, pct[i] > TARGET_NULL_WARN_PCT, pct[i]))
    found.append(("large_table", "", megabytes > LARGE_TABLE_MB, megabytes))
    rows = F.array(*[F.struct(F.lit(issue).alias("issue"), F.lit(c).alias("column"), value.cast("double").alias("value"), fires.alias("fires"))
                     for issue, c, fires, value in found])
    out = wide.select(F.inline(rows)).where("fires").select("issue", "column", "value")
    copies = duplicate_rows(df).where("duplicate_rows > 0")
    out = out.unionByName(copies.select(F.lit("duplicate_rows").alias("issue"), F.lit("").alias("column"),
                                        F.col("duplicate_rows").cast("double").alias("value")))
    if target in names and (target in families(df).categorical or distinct[target] < 20):
        out = out.unionByName(class_imbalance(df, target).where("imbalanced")
                              .select(F.lit("class_imbalance").alias("issue"), F.lit(target).alias("column"), F.col("ratio").alias("value")))
    return out


def facts_frame(df: DataFrame, facts: TableFacts) -> DataFrame:
    """The profile counters as one row, for the rule tables and the report overview."""
    values = {
        "n_rows": facts.rows, "n_columns": len(df.columns), "null_cells": facts.null_cells,
        "null_pct": facts.null_pct, "duplicates": facts.duplicates,
        "high_null_columns": len(facts.high_null()), "constant_columns": len(facts.constants()),
        "identifier_columns": len(facts.identifiers()),
        "high_cardinality_columns": sum(c.family == "categorical" and c.distinct > 100 for c in facts.columns.values()),
        "numeric_columns": len(facts.kinds.numeric), "categorical_columns": len(facts.kinds.categorical),
        "datetime_columns": len(facts.kinds.datetime), "boolean_columns": len(facts.kinds.boolean),
    }
    return df.sparkSession.createDataFrame([tuple(float(v) for v in values.values())],
                                           ", ".join(f"{k} double" for k in values))


def profile_advice(df: DataFrame, facts: TableFacts, correlated: int = 0) -> DataFrame:
    """Warnings, suggestions and the review flag; ``correlated`` counts the correlated pairs."""
    c = F.col
    copies_pct = F.coalesce(F.try_divide(c("duplicates") * 100, c("n_rows")), F.lit(0.0))
    warnings = [
        Rule("warning", "overall_nulls", c("null_pct") > 30, c("null_pct")),
        Rule("warning", "many_high_null_columns", c("high_null_columns") > 10, c("high_null_columns")),
        Rule("warning", "many_duplicates", c("duplicates") > c("n_rows") * 0.1, copies_pct),
        Rule("warning", "many_constant_columns", c("constant_columns") > 5, c("constant_columns")),
    ]
    any_warning = F.lit(False)
    for w in warnings:
        any_warning = any_warning | w.fires
    review = (c("high_null_columns") > 5) | (c("null_pct") > 30) | any_warning
    hints = [
        Rule("suggestion", "drop_high_null", c("high_null_columns") > 0, c("high_null_columns")),
        Rule("suggestion", "drop_constant", c("constant_columns") > 0, c("constant_columns")),
        Rule("suggestion", "encode_high_cardinality", c("high_cardinality_columns") > 0, c("high_cardinality_columns")),
        Rule("suggestion", "drop_identifiers", c("identifier_columns") > 0, c("identifier_columns")),
        Rule("suggestion", "drop_duplicates", c("duplicates") > 0, c("duplicates")),
        Rule("suggestion", "drop_correlated", F.lit(correlated > 0), F.lit(correlated)),
        Rule("review", "needs_review", review, F.lit(1.0)),
    ]
    return fired(facts_frame(df, facts), [*warnings, *hints])


def data_overview(df: DataFrame, facts: TableFacts, target: str | None = None) -> DataFrame:
    """One-row overview for the report."""
    return facts_frame(df, facts).select(
        *[F.col(c).cast("bigint").alias(c) for c in (
            "n_rows", "n_columns", "null_cells", "duplicates", "high_null_columns", "constant_columns",
            "numeric_columns", "categorical_columns", "datetime_columns", "boolean_columns")],
        "null_pct", F.lit(target or "").alias("target"))

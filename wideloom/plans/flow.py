"""The eight stages from a raw table to an evaluated model, and their stored snapshots."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wideloom.functions.columns import col
from wideloom.operators import cleaning, encoding, evaluate, features, models, quality, selection, split
from wideloom.operators.profile import column_summary, table_facts
from wideloom.operators.relations import is_classification
from wideloom.operators.runlog import STAGES
from wideloom.session import cut

MANIFEST = "run string, version bigint, stage string, path string, ts timestamp, event string"
FEEDBACK = "ts timestamp, session string, stage string, text string, overrides map<string,string>, preferences map<string,string>"
RUN_LOG = "session string, phase string, success boolean, ts timestamp, detail string"


@dataclass
class Params:
    """Everything a user may override, stage by stage."""

    exclude: Sequence[str] = ()
    skip_cleaning: Sequence[str] = ()
    transforms: Sequence[Callable[[DataFrame], DataFrame]] = ()
    methods: Sequence[str] = selection.METHODS
    include_features: Sequence[str] = ()
    exclude_features: Sequence[str] = ()
    max_new_ratio: float = features.MAX_NEW_RATIO
    skip_features: Sequence[str] = ()
    skip_feature_types: Sequence[str] = ()
    hooks: Sequence = ()
    models: Sequence[str] | None = None
    model_params: Mapping[str, object] = field(default_factory=dict)
    task: str | None = None
    split_first: bool = True
    test_share: float = split.TEST_SHARE
    seed: int = split.SEED


class FlowFailed(ValueError):
    """A stage failed; ``log`` has the rows of the run up to and with that stage."""

    def __init__(self, message: str, log: list[tuple]):
        super().__init__(message)
        self.log = log


@dataclass
class Outcome:
    checks: DataFrame
    issues: DataFrame
    advice: DataFrame
    plan: list[cleaning.CleaningOp]
    cleaned: cleaning.Cleaned
    selected: selection.Selection
    feature_ops: list[features.FeatureOp]
    train: DataFrame
    test: DataFrame
    results: list[models.Trained]
    board: DataFrame
    best: models.Trained | None
    log: list[tuple]

    def report(self) -> dict[str, DataFrame]:
        """The tables a report is made of."""
        spark = self.board.sparkSession
        shares = spark.createDataFrame(list(self.best.importances.items()) if self.best else [], "feature string, importance double")
        return {
            "checks": self.checks, "issues": self.issues, "advice": self.advice,
            "cleaning": cleaning.plan_frame(self.train, self.cleaned.applied), "selection": self.selected.frame(),
            "features": features.feature_log(self.train, self.feature_ops), "leaderboard": self.board,
            "importance": evaluate.importance_share(shares), "columns": column_summary(self.train),
        }


def run_flow(df: DataFrame, target: str, keys: Sequence[str], params: Params | None = None, *, session: str = "run",
             stages: "Stages | None" = None) -> Outcome:
    """Ingest, profile, clean, select, engineer, train, evaluate and report.

    With ``split_first`` (the default) everything is fitted on the training rows and replayed on
    the test rows.  Without it the table is prepared as a whole and split before training.
    Stage ends are materialised because later stages read them several times.  A failing stage is
    logged as not successful before ``FlowFailed`` is raised.
    """
    log: list[tuple] = []
    try:
        return _run_stages(df, target, keys, params or Params(), session, stages, log)
    except Exception as failure:
        stage = STAGES[min(len(log), len(STAGES) - 1)]
        log.append((session, stage, False, datetime.now(timezone.utc).replace(tzinfo=None), str(failure)))
        raise FlowFailed(f"{stage}: {failure}", log) from failure


def _run_stages(df: DataFrame, target: str, keys: Sequence[str], p: Params, session: str, stages: "Stages | None", log: list[tuple]) -> Outcome:
    row_key = "row_key"

    def done(stage: str, frame: DataFrame | None = None, detail: str = "") -> None:
        log.append((session, stage, True, datetime.now(timezone.utc).replace(tzinfo=None), detail))
        if stages is not None and frame is not None:
            stages.save(stage, frame)

    raw = df.drop(*[c for c in p.exclude if c in df.columns and c != target])
    checks = quality.ingest_validation(raw, target)
    failed = [r["check"] for r in checks.where("level = 'error' AND NOT passed").collect()]
    if failed:
        raise ValueError(f"table not usable: {', '.join(failed)}")
    issues = quality.quality_issues(raw, target)
    classify = is_classification(raw, target, p.task)
    keyed = raw.withColumn(row_key, split.shuffle_key(keys, p.seed)).drop(*[k for k in keys if k != target])
    if p.split_first:
        marked = cut(split.with_split(keyed, [row_key], target if classify else None, test_share=p.test_share, seed=p.seed))
        train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    else:
        train, test = cut(keyed), None
    done("ingestion", train)

    facts = table_facts(train.drop(row_key))
    advice = quality.profile_advice(train.drop(row_key), facts)
    done("profiling")

    ops = cleaning.skip_types(cleaning.plan_cleaning(train.drop(row_key), target, facts), p.skip_cleaning)
    cleaned = cleaning.apply_cleaning(train, ops, p.transforms, keep=[row_key], facts=facts)
    train = cut(cleaned.data)
    if test is not None:
        replay = [o for o in cleaned.applied if o.op_type != "remove_duplicates"]
        test = cleaning.apply_cleaning(test, replay, p.transforms, keep=[row_key]).data
    done("cleaning", train)

    selected = selection.select_features(train.drop(row_key), target, task=p.task, methods=p.methods,
                                         include=p.include_features, exclude=p.exclude_features)
    wanted = [row_key, *selected.kept, target]
    train = train.select(*[col(c) for c in wanted])
    test = None if test is None else test.select(*[col(c) for c in wanted])
    done("selection", train)

    encoders = encoding.fit_encoders(train.drop(row_key), target)
    encoded = encoding.apply_encoders(train, encoders)
    feature_ops = features.plan_features(encoded.drop(row_key), target, max_new_ratio=p.max_new_ratio,
                                         skip=p.skip_features, skip_types=p.skip_feature_types)
    feature_ops = features.fit_features(encoded, feature_ops)
    engineered, feature_ops = features.apply_features(encoded, feature_ops, p.hooks)
    if test is not None:
        test = features.apply_features(encoding.apply_encoders(test, encoders, train), feature_ops, p.hooks, encoded)[0]
    train = engineered
    done("features", train)

    if test is None:
        marked = cut(split.with_split(train, [row_key], target if classify else None, test_share=p.test_share, seed=p.seed))
        train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    prepared = models.prepare(train, test, target, [row_key], task="classification" if classify else "regression")
    results = models.train_models(prepared, p.models, **p.model_params)
    done("modeling", detail=", ".join(r.name for r in results))

    board = models.leaderboard(models.leaderboard_frame(df.sparkSession, results), prepared.task)
    names = [r["model"] for r in models.best_model(board.where("error = ''"), prepared.task).collect()]
    best = next((r for r in results if names and r.name == names[0]), None)
    done("evaluation")
    done("report")
    return Outcome(checks, issues, advice, ops, cleaned, selected, feature_ops, train, test, results, board, best, log)


def run_log_frame(spark: SparkSession, log: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(log), RUN_LOG)


def feedback_row(spark: SparkSession, session: str, stage: str, text: str, overrides: Mapping[str, object] | None = None,
                 preferences: Mapping[str, object] | None = None) -> DataFrame:
    """One feedback row for the history table."""
    plain = lambda m: {k: str(v) for k, v in (m or {}).items()}
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(now, session, stage, text, plain(overrides), plain(preferences))], FEEDBACK)


class Stages:
    """Stage tables of one run: Parquet per version and a manifest to resume and roll back.

    The manifest is append-only.  Rolling back to a stage adds a row; what came after that stage
    is no longer visible, while its files stay.
    """

    def __init__(self, spark: SparkSession, base: str, run: str, order: Sequence[str] = STAGES):
        self.spark, self.base, self.run, self.order = spark, base.rstrip("/"), run, tuple(order)

    @property
    def _manifest(self) -> str:
        return f"{self.base}/manifest"

    def history(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(self._manifest).where(F.col("run") == self.run)

    def save(self, stage: str, df: DataFrame) -> str:
        version = self._next()
        path = f"{self.base}/{self.run}/{stage}/v{version}"
        df.write.mode("error").parquet(path)
        self._add(version, stage, path, "saved")
        return path

    def current(self) -> DataFrame:
        """``(stage, version, path)`` of the visible snapshots."""
        place = F.array_position(F.array(*[F.lit(s) for s in self.order]), F.col("stage"))
        later = W.partitionBy("run").orderBy("version").rowsBetween(1, W.unboundedFollowing)
        # The manifest of a run has one row per save or rollback.
        rows = self.history().withColumn("place", place).withColumn(
            "kept_to", F.min(F.when(F.col("event") == "rollback", F.col("place"))).over(later))
        visible = rows.where((F.col("event") == "saved") & (F.col("kept_to").isNull() | (F.col("place") <= F.col("kept_to"))))
        newest = W.partitionBy("stage").orderBy(F.desc("version"))
        return visible.withColumn("n", F.row_number().over(newest)).where("n = 1").select("stage", "version", "path")

    def load(self, stage: str) -> DataFrame:
        row = self.current().where(F.col("stage") == stage).head()
        if row is None:
            raise KeyError(f"no snapshot of {stage} in run {self.run}")
        return self.spark.read.parquet(row["path"])

    def rollback(self, stage: str) -> DataFrame:
        """Drop later snapshots from view and return the stage's table."""
        found = self.load(stage)
        self._add(self._next(), stage, "", "rollback")
        return found

    def last_stage(self) -> str | None:
        """Where to resume."""
        seen = {r["stage"] for r in self.current().collect()}
        return next((s for s in reversed(self.order) if s in seen), None)

    def _next(self) -> int:
        try:
            return (self.history().agg(F.max("version")).head()[0] or 0) + 1
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return 1

    def _add(self, version: int, stage: str, path: str, event: str) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(self.run, version, stage, path, now, event)], MANIFEST).coalesce(1) \
            .write.mode("append").parquet(self._manifest)

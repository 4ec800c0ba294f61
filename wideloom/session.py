"""Session helpers: defaults for a fresh session and lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "wideloom", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller passes its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session, so that it need not be installed on executors."""
    context = spark.sparkContext
    if getattr(context, "_wideloom_sent", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # else the package is itself read from an archive that was sent
        archive = Path(tempfile.mkdtemp(prefix="wideloom-")) / "wideloom.zip"  # served by the driver to every executor
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
    context._wideloom_sent = True


def shared_dir(spark: SparkSession) -> str | None:
    """The checkpoint folder of the session, set here only for local runs that lack one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        return None
    made = tempfile.mkdtemp(prefix="wideloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` so later passes neither recompute it nor drag its lineage along.

    Uses a reliable checkpoint in the shared folder.  A cluster without such a folder gets a
    disk cache instead, which Spark can rebuild from lineage when an executor is lost.
    """
    if shared_dir(df.sparkSession) is None:
        return df.persist(StorageLevel.DISK_ONLY)
    return df.checkpoint(eager=True)

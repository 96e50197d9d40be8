"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
OWN_TO_A_RUN = ("spark.app.", "spark.driver.port", "spark.driver.host", "spark.executor.id", "spark.ui.", "spark.repl.", "spark.submit.pyFiles")


def get_session(app: str = "voxelframe", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with adaptive execution on. Keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items() | {(k.replace("__", "."), v) for k, v in conf.items()}:
        b = b.config(k, v)
    return b.getOrCreate()


def get_spark_session(master: str = "local[*]", appname: str = "voxelframe", dicconf: Mapping[str, str] | None = None) -> SparkSession:
    """The same by master, name and a map of settings."""
    b = SparkSession.builder.master(master).appName(appname)
    for k, v in (DEFAULTS | dict(dicconf or {})).items():
        b = b.config(k, v)
    return b.getOrCreate()


def load_user_conf(spark: SparkSession | None = None) -> dict[str, str]:
    """The settings of the (active) session that its user gave, for a later :func:`get_spark_session`."""
    spark = spark or SparkSession.getActiveSession()
    return {} if spark is None else {k: v for k, v in spark.sparkContext.getConf().getAll() if not k.startswith(OWN_TO_A_RUN)}


def set_log_level(spark: SparkSession, level: str = "WARN") -> None:
    spark.sparkContext.setLogLevel(level)


set_spark_log_level = set_log_level


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so that executors need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_voxelframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="voxelframe-")) / "voxelframe.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._voxelframe_shipped = True

"""Session defaults and the few facts the library reads from a running session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from assayline.errors import DataQualityError

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "assayline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the rules rely on: UTC times, ANSI casts, AQE."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise DataQualityError("Set spark.checkpoint.dir to a folder all executors share.")
        current = tempfile.mkdtemp(prefix="assayline-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder, so later reads see the same rows."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder, and read back: smaller than a checkpoint, and of known size to the planner.

    Lineage ends there. The folder is removed when the driver's JVM ends.
    """
    spark = frame.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/assayline-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(frame.schema).parquet(folder)


def planned_bytes(frame: DataFrame) -> int | None:
    """Catalyst's own size estimate of a frame, or None where the session hides it."""
    plan = getattr(frame, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (negative: never broadcast)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if text.endswith(suffix):
            return int(float(text[: -len(suffix)]) * units[suffix])
    return int(text)

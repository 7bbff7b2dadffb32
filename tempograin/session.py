"""Session settings, durable lineage cuts and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A plan whose estimated input is below this is processed without chunking.
SMALL_PLAN_BYTES = 128 * 1024 * 1024
DEFAULT_ROWS_PER_CHUNK = 2_000_000
ROWS_PER_CHUNK_KEY = "tempograin.rowsPerChunk"


def build_session(app: str = "tempograin", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: both come from
    the submit configuration and AQE coalesces the partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "16g")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests, a laptop) gets a folder of its own; on a
    cluster such a folder would be the driver's alone, so the setting is required.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and context.getCheckpointDir() is None and not re.match(r"local($|\[)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_per_chunk(spark: SparkSession) -> int | None:
    """The chunk size asked for by the session, or None for the default."""
    value = spark.conf.get(ROWS_PER_CHUNK_KEY, None)
    return int(value) if value else None


def estimated_bytes(df: DataFrame) -> int:
    """A size estimate from the optimised plan's inputs; runs no job.

    Joins here match on keys, so the inputs are summed, not multiplied; every exploding
    step is assumed to multiply the rows by 64. A wrong guess costs time, never rows.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    explodes = plan.toString().count("Generate ")
    return total * 64 ** explodes


def surely_small(df: DataFrame) -> bool:
    """Whether no group of ``df`` can outgrow a task, judged without a job.

    An explicit chunk size switches the shortcut off.
    """
    return rows_per_chunk(df.sparkSession) is None and estimated_bytes(df) <= SMALL_PLAN_BYTES


__all__ = ["build_session", "shared_folder", "scratch_path", "durable",
           "rows_per_chunk", "estimated_bytes", "surely_small",
           "DEFAULT_ROWS_PER_CHUNK", "ROWS_PER_CHUNK_KEY"]

"""Incremental ingest: new session documents and clips are handled once, as they arrive.

Both streams are stateless, run on the available files and stop. A batch writes its own
folder, so a batch repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.operators import audit
from tempograin.session import scratch_path
from tempograin.sources import documents as docs

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process what is there now through ``transform`` into ``out`` and return."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    conf = stream.sparkSession.conf
    before = conf.get(LISTING_TASKS)
    conf.set(LISTING_TASKS, str(min(int(before), 32)))  # else a batch starts a task for each of its files to find it
    try:
        query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
                 .foreachBatch(write).start())
        query.awaitTermination()
    finally:
        conf.set(LISTING_TASKS, before)


def ingest_documents(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 1000) -> DataFrame:
    """Flattened side scalars of every document in ``folder``, each document once.

    A document that cannot be read, or lacks its block, is one dropped row without a key;
    its ``err`` says why. For all other rows it is empty.
    """
    stream = (spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", per_batch).text(folder)
              .select("value", F.col("_metadata.file_path").alias("path")))

    def flatten(batch: DataFrame) -> DataFrame:
        judged = docs.batch_status(batch, "$.dv_r")
        parsed = judged.filter("ok").select("path", F.try_parse_json("value").alias("doc"))
        flat = docs.flatten_blocks(parsed, ["path"], "doc", {"left": "$.dv_r.left", "right": "$.dv_r.right"})
        failed = judged.filter("not ok").select(
            "path", F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"),
            F.lit(True).alias("dropped"), "err")
        return flat.withColumn("err", F.lit("")).unionByName(failed)
    run_available(stream, flatten, out, checkpoint)
    return spark.read.schema("path string, key string, value double, dropped boolean, err string").option("recursiveFileLookup", True).parquet(out)


def check_clips(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> DataFrame:
    """The input checks and worst status of every clip row in ``folder``."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def judge(batch: DataFrame) -> DataFrame:
        checked = batch.withColumn("checks", audit.input_checks())
        return checked.select("clip", audit.worst_status(F.col("checks")).alias("verdict"), "checks")
    run_available(stream, judge, out, checkpoint)
    return spark.read.option("recursiveFileLookup", True).parquet(out)


def work_folders(spark: SparkSession, stem: str) -> tuple[str, str]:
    """A fresh output and checkpoint folder in the shared folder."""
    root = scratch_path(spark, stem)
    return f"{root}/out", f"{root}/checkpoint"

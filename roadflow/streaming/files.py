"""Streams from files to files: a file source, changes of a result by batch, and the result that they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, like: DataFrame, names: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream with the columns of ``like``; each trigger takes ``per_trigger`` files (all, if None), the oldest first."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", names)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_available(changes: DataFrame, folder: str, checkpoint: str) -> None:
    """Process all that is there and stop; the changes of batch i are written to ``folder/batch=i``.

    A batch that is repeated after a failure overwrites its own folder, so each counts once.  State lives in RocksDB on the executors' disks and is
    committed to the checkpoint, which must be in a folder that all of them share.
    """
    conf = changes.sparkSession.conf
    before = conf.get(PROVIDER, None)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    conf.set(PROVIDER, ROCKS)
    try:
        query = changes.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before is not None else conf.unset(PROVIDER)


def result(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The rows of the last batch that changed a key, for every key."""
    changes = spark.read.parquet(folder)
    last = changes.withColumn("_last", F.max("batch").over(W.partitionBy(*keys)))
    return last.where(F.col("batch") == F.col("_last")).drop("batch", "_last")

"""Tables written once to the folder that driver and executors share.

Loops cut their lineage with these, so a lost executor costs a reread and no more.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset in a local session (tests) a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="roadflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write a table as Parquet and open it; Spark deletes the shuffle files behind it as soon as it stands."""
    conf, schema = df.sparkSession.conf, df.schema
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    return df.sparkSession.read.schema(schema).parquet(path)


class Rounds:
    """Keeps the state of an iterative operator as Parquet, one folder for each round."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        out = write_once(df, path)
        out._round_path = path
        return out

    def save_counting(self, df: DataFrame, what: Column) -> tuple[DataFrame, int]:
        """The written table, and for how many of its rows ``what`` holds; counted while they are written, in the same job.

        Tasks that run twice may count twice, so the number says whether there are any.
        """
        seen = Observation()
        return self.save(df.observe(seen, F.count_if(what).alias("n"))), seen.get["n"]

    def drop(self, df: DataFrame) -> None:
        """Delete the state of a round that no later plan reads."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(df._round_path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

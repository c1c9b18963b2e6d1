"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.scratch import Rounds


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """1, 2, ... in the order of the columns (which should be total).

    Rows are range-partitioned and kept with their partition's number; the sizes of the partitions,
    a few numbers, give each partition its first row number.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kept = Rounds(spark, "ordering").save(ranged)
    sizes = sorted((r["_part"], r["count"]) for r in kept.groupBy("_part").count().collect())  # one row for each partition
    firsts, seen = [], 0
    for part, n in sizes:
        firsts.append((part, seen))
        seen += n
    offsets = spark.createDataFrame(firsts or [(0, 0)], "_part int, _first long")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return kept.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_first") + inside).drop("_part", "_first")

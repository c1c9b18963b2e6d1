"""Weighted draws with replacement: running sums over ranges of an order, and a lookup of each draw in its range.

Weights are whole numbers, so sums are exact, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.scratch import Rounds

#: Draws that one task looks up at most.
MOST_DRAWS = 1_000_000


def running_sums(df: DataFrame, weight: str, order: list[str], out: str, rounds: Rounds | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(rows with their range ``_part`` and the running sum ``out`` in a total order, [(range, sum before it, sum with it)]).

    Rows are dealt into ranges of the order; the sums of the ranges, some numbers, give each its first sum.  Rows without a
    weight, or with one that is not positive, are left out.
    """
    rounds = rounds or Rounds(df.sparkSession, "draws")
    held = rounds.save(df.where(F.col(weight) > 0).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ranges, seen = [], 0
    for part, total in sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.sum(weight).alias("n")).collect()):  # one row for each partition
        ranges.append((part, seen, seen + total))
        seen += total
    first = df.sparkSession.createDataFrame(ranges or [(0, 0, 0)], "_part int, _low long, _high long")
    inside = F.sum(weight).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return held.join(F.broadcast(first.select("_part", "_low")), "_part").withColumn(out, (F.col("_low") + inside).cast("long")).drop("_low"), ranges


def weighted_draws(items: DataFrame, weight: str, order: list[str], draws: DataFrame, num: str, den: int) -> DataFrame:
    """The columns of ``draws`` with the ``order`` columns of the item that each hits; no rows without an item of positive weight.

    A draw's point is floor(total weight * ``num`` / ``den``), with whole numbers 0 <= num < den below 2**31; it hits the item
    whose running sum is the first above it, so an item has as many points as its weight.  Points are looked up in the range of the order that
    they fall into; a range that many draws hit is split, and its items, which are few, go with each part of it.  Draws without a
    number, or with one out of bounds, are left out.
    """
    rounds = Rounds(items.sparkSession, "draws")
    sums, ranges = running_sums(items, weight, order, "_at", rounds)
    spark, total = items.sparkSession, ranges[-1][2] if ranges else 0
    asked = draws.columns
    # the product may pass 64 bits, so whole parts and rests are multiplied apart
    point = F.lit(total // den) * F.col(num) + F.expr(f"({total % den}L * `{num}`) div {den}L")
    placed = draws.where(F.col(num).between(0, den - 1) & F.lit(total > 0)).withColumn("_at", point.cast("long"))
    bounds = spark.createDataFrame(ranges or [(0, 0, 0)], "_part int, _low long, _high long")  # one row for each partition
    placed = rounds.save(placed.join(F.broadcast(bounds), (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))).drop("_low", "_high"))
    split = {r["_part"]: -(-r["count"] // MOST_DRAWS) for r in placed.groupBy("_part").count().collect()}  # one row for each partition
    splits = F.broadcast(spark.createDataFrame(list(split.items()) or [(0, 1)], "_part int, _n long"))
    mine = placed.join(splits, "_part").withColumn("_salt", F.pmod(F.xxhash64(*asked), F.col("_n")))
    theirs = sums.select("_part", "_at", F.struct(*order).alias("_item")).join(splits, "_part").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    both = mine.select("_part", "_salt", "_at", F.lit(0).alias("_kind"), F.struct(*asked).alias("_draw"), F.lit(None).cast(theirs.schema["_item"].dataType).alias("_item"))
    both = both.unionByName(theirs.select("_part", "_salt", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(both.schema["_draw"].dataType).alias("_draw"), "_item"))
    # from the highest sum down, the last item seen is the first one above a point; an item whose sum is the point is not above it
    w = W.partitionBy("_part", "_salt").orderBy(F.desc("_at"), "_kind").rowsBetween(W.unboundedPreceding, 0)
    hit = both.withColumn("_hit", F.last("_item", ignorenulls=True).over(w)).where("_kind = 0")
    return hit.select("_draw.*", *[F.col(f"_hit.{c}").alias(c) for c in order])

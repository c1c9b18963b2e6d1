"""Logical tables of the engine over the star-schema test data (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, a: int, b: int, c: int, d: int):
    """Coordinates from integer arithmetic on a key."""
    lon = f"144.45D + (({key} * {a} + {key} * {key} * {b}) % 1103) / 1000.0D"
    lat = f"-38.05D + (({key} * {c} + {key} * {key} * {d}) % 601) / 1000.0D"
    return F.expr(lon).alias("lon"), F.expr(lat).alias("lat")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal sites: one for each customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("site_no"), F.col("c_name").alias("site_name"), F.col("c_mktsegment").alias("site_type"), *_place("c_custkey", 7919, 31, 104729, 17))


def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools: one for each supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("school_id"), *_place("s_suppkey", 6007, 13, 5003, 29))


def detector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each detector event; some values are made null or negative, as in raw counts."""
    e = table(spark, sf_dir, "events")
    value = F.expr("case when event_id % 97 = 0 then null when event_id % 89 = 0 then -1023D else value end")
    return e.select("event_id", F.col("user_id").alias("NB_SCATS_SITE"), F.col("event_type").alias("NB_DETECTOR"), "ts", F.to_date("ts").alias("date"), value.alias("value"))

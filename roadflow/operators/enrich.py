"""Lookups that enrich daily rows: site type, day type, nearby schools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.functions.calendar import month_day
from roadflow.operators.clean import digits

#: Month-day of the built-in holiday table.
HOLIDAYS = [
    ("01-01", "New Year's Day"),
    ("01-26", "Australia Day"),
    ("03-10", "Labour Day"),
    ("04-18", "Good Friday"),
    ("04-19", "Saturday before Easter Sunday"),
    ("04-20", "Easter Sunday"),
    ("04-21", "Easter Monday"),
    ("04-25", "ANZAC Day"),
    ("06-09", "King's Birthday"),
    ("11-04", "Melbourne Cup"),
    ("12-25", "Christmas Day"),
    ("12-26", "Boxing Day"),
]


def last_wins(lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the value of the highest order for each key that is not null."""
    return lookup.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def look_up(df: DataFrame, lookups: list[DataFrame], key: str, out: str, default: Column | None = None) -> DataFrame:
    """Left joins on ``key`` with lookups of (key, value); the first hit counts, then the default."""
    found = []
    for i, lookup in enumerate(lookups):
        value = next(c for c in lookup.columns if c != key)
        df = df.join(lookup.select(key, F.col(value).alias(f"_found{i}")), key, "left")
        found.append(F.col(f"_found{i}"))
    if default is not None:
        found.append(default)
    return df.withColumn(out, F.coalesce(*found)).drop(*[f"_found{i}" for i in range(len(lookups))])


def holiday_lookup(df: DataFrame, date: str = "Date", name: str = "Holiday Name", jurisdiction: str = "Jurisdiction", region: str = "vic") -> DataFrame:
    """(md, day_type) from a holiday table with yyyymmdd texts; other texts are skipped, the last row of a month-day counts."""
    rows = df.withColumn("_order", F.monotonically_increasing_id()).where(F.lower(jurisdiction) == region).where(digits(F.col(date), 8))
    md = F.concat_ws("-", F.substring(date, 5, 2), F.substring(date, 7, 2))
    return rows.select(md.alias("md"), F.col(name).alias("day_type"), "_order").groupBy("md").agg(F.max_by("day_type", "_order").alias("day_type"))


def day_type(df: DataFrame, date: str, holidays: DataFrame | None = None, out: str = "day_type", normal: str = "normal") -> DataFrame:
    """Name of the holiday on the row's month and day, whatever the year; other days are normal.

    Without a table the built-in one is used, as a literal: no join.
    """
    if holidays is None:
        md = month_day(F.col(date))
        return df.withColumn(out, F.coalesce(*[F.when(md == k, F.lit(v)) for k, v in HOLIDAYS], F.lit(normal)))
    named = holidays.groupBy(F.col("md").alias("_md")).agg(F.max("day_type").alias("_dt")).where(F.length("_md") == 5)  # a row for each day of a year at most
    return df.join(F.broadcast(named), month_day(F.col(date)) == F.col("_md"), "left").withColumn(out, F.coalesce("_dt", F.lit(normal))).drop("_md", "_dt")

"""Cleaning and reshaping of wide detector counts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.functions.calendar import slot_time


def flow_columns(df: DataFrame) -> list[str]:
    """Columns named V and digits, in order."""
    return [c for c in df.columns if re.fullmatch(r"V\d+", c)]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def complete(flows: list[str]) -> Column:
    """No flow is null."""
    return _all([F.col(c).isNotNull() for c in flows])


def non_negative(flows: list[str]) -> Column:
    """No flow is below zero (zeros stay)."""
    return _all([F.col(c) >= 0 for c in flows])


def clean(df: DataFrame, flows: list[str] | None = None) -> DataFrame:
    """Rows whose flows are all present and none is negative."""
    flows = flows or flow_columns(df)
    return df.where(complete(flows) & non_negative(flows))


def drop_counters(df: DataFrame, flows: list[str] | None = None) -> DataFrame:
    """One row: rows before, dropped for nulls, dropped for negatives, after."""
    flows = flows or flow_columns(df)
    full = complete(flows)
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~full).alias("dropped_null"),
        F.count_if(full & ~non_negative(flows)).alias("dropped_negative"),
        F.count_if(full & non_negative(flows)).alias("rows_after"),
    )


def extents(df: DataFrame, flows: list[str] | None = None) -> DataFrame:
    """One row: smallest and largest flow of all columns, and how many are zero."""
    flows = flows or flow_columns(df)
    zeros = reduce(lambda a, b: a + b, [F.when(F.col(c) == 0, 1).otherwise(0) for c in flows])
    low = F.least(*flows) if len(flows) > 1 else F.col(flows[0])
    high = F.greatest(*flows) if len(flows) > 1 else F.col(flows[0])
    return df.agg(F.min(low).alias("min_flow"), F.max(high).alias("max_flow"), F.sum(zeros).alias("zeros"))


def sum_detectors(df: DataFrame, keys: list[str], flows: list[str] | None = None) -> DataFrame:
    """Sum over the detectors of a key; rows with a null key part are left out, and a sum of nulls is 0."""
    flows = flows or flow_columns(df)
    return df.where(_all([F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in flows])


def pivot_slots(df: DataFrame, keys: list[str], slot: str, slots: list[int], flows: list[str]) -> DataFrame:
    """One row for each key with columns ``{flow}_{slot}`` (means); the slots are given, so no job looks for them."""
    made = [F.avg(F.when(F.col(slot) == s, F.col(c))).alias(f"{c}_{s}") for c in flows for s in slots]
    return df.groupBy(*keys).agg(*made)


def unpivot_slots(df: DataFrame, ids: list[str], flows: list[str] | None = None, name: str = "time_idx", value: str = "Flow") -> DataFrame:
    """Long form, one row for each flow column; null flows stay."""
    return df.unpivot(ids, flows or flow_columns(df), name, value)


def date_range(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from a first to a last day, both inclusive; a bound that is not given doesn't count."""
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def digits(text: Column, n: int) -> Column:
    """Whether a text is n digits and nothing else."""
    return text.rlike(f"^[0-9]{{{n}}}$")


def members(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other frame has."""
    return df.join(known.select(key), key, "left_semi")


def missing(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other frame lacks."""
    return df.join(known.select(key), key, "left_anti")


def coverage(df: DataFrame, key: str, value: str, out: str = "all") -> DataFrame:
    """(key, out): whether a key has every value that occurs anywhere."""
    every = df.agg(F.count_distinct(value).alias("_every"))  # one row
    have = df.groupBy(key).agg(F.count_distinct(value).alias("_have"))
    return have.crossJoin(F.broadcast(every)).select(key, (F.col("_have") == F.col("_every")).alias(out))


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(*order).limit(n)


def long_series(df: DataFrame, ids: list[str], flows: list[str], start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Long series with ``time`` as HH:MM; one or both bounds of the date are inclusive."""
    return unpivot_slots(date_range(df, date, start, end), ids, flows).withColumn("time", slot_time(F.col("time_idx"))).drop("time_idx")


def profile(df: DataFrame, site: str, date: str, flow: str) -> DataFrame:
    """One row: least, largest and mean flow, sites, dates, null and negative flows."""
    f = F.col(flow)
    return df.agg(F.min(f).alias("min_flow"), F.max(f).alias("max_flow"), F.avg(f).alias("mean_flow"), F.stddev_pop(f).alias("std_flow"), F.countDistinct(site).alias("sites"), F.countDistinct(date).alias("dates"), F.count_if(f.isNull()).alias("null_flows"), F.count_if(f < 0).alias("negative_flows"))


def read_union(frames: list[DataFrame]) -> DataFrame:
    """Union of yearly frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

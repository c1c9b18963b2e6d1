"""Slots, labels, dates and cyclical time features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(ts: Column) -> Column:
    """Quarter of an hour in the day, 0 to 95."""
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("int")


def slot_time(name: Column) -> Column:
    """``HH:MM`` of a column name such as V07, V07_0 or V07_0.0; null for other names."""
    n = F.regexp_extract(name, r"^V(\d{1,2})(?:_\d+(?:\.0)?)?$", 1)
    k = F.when(n != "", n.cast("int"))
    return F.when(k.isNotNull(), F.format_string("%02d:%02d", F.floor(k / 4).cast("int"), (k % 4) * 15))


def parse_dates(df: DataFrame, column: str, formats: list[str], out: str = "date") -> DataFrame:
    """The first format that fits any row of the column is used for all of it; without one the result is null."""
    tries = [F.try_to_timestamp(F.col(column), F.lit(f)).cast("date") for f in formats]
    hits = df.agg(*[F.count(t).alias(f"h{i}") for i, t in enumerate(tries)]).first()
    best = next((t for i, t in enumerate(tries) if hits[i]), F.lit(None).cast("date"))
    return df.withColumn(out, best)


def date_time(date: Column, time: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Timestamp of a date text and a time text; null where they don't parse."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(pattern))


def date_time_of(columns: list[str], names: tuple[tuple[str, str], ...] = (("date", "time"), ("QT_DATE", "QT_TIME"))) -> Column:
    """``date_time`` of the first pair of columns that is there and parses."""
    there = [date_time(F.col(d), F.col(t)) for d, t in names if d in columns and t in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("timestamp")


def date_in_name(name: Column) -> Column:
    """The date in a file name's first run of eight digits."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def _cycle(value: Column, period: float, name: str) -> list[Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def cyclical(ts: Column) -> list[Column]:
    """Sine and cosine of weekday/7 (Monday 0), (month-1)/12, hour/23 and minute/59, in this order."""
    return [*_cycle(F.weekday(ts), 7, "dow"), *_cycle(F.month(ts) - 1, 12, "month"), *_cycle(F.hour(ts), 23, "hour"), *_cycle(F.minute(ts), 59, "minute")]


def clock_from_cycle(sin: Column, cos: Column, period: float) -> Column:
    """The value whose sine and cosine over a period are given."""
    return F.round(F.pmod(F.atan2(sin, cos) / F.lit(2 * math.pi), F.lit(1.0)) * period, 6)


def next_cycle(names: dict[str, Column], minutes: int = 15) -> list[Column]:
    """The eight ``cyclical`` columns a step later, from the columns themselves.

    Minute and hour are read back from their sines and cosines and advanced; past midnight the weekday goes on by one; the month
    stays.  The last values of hour and minute share their angle with 0 (23 and 59 are whole periods) and count as 0 then.
    """
    back = lambda n, p: F.round(clock_from_cycle(names[f"{n}_sin"], names[f"{n}_cos"], p)).cast("int") % p
    minute = back("minute", 59) + minutes
    hour = back("hour", 23) + F.floor(minute / 60).cast("int")
    day = (back("dow", 7) + F.floor(hour / 24).cast("int")) % 7
    return [*_cycle(day, 7, "dow"), names["month_sin"].alias("month_sin"), names["month_cos"].alias("month_cos"), *_cycle(hour % 24, 23, "hour"), *_cycle(minute % 60, 59, "minute")]


def positional_encoding(length: int, width: int) -> Column:
    """array[length][width] of sinusoidal position codes."""
    def one(pos: Column) -> Column:
        rate = lambda i: F.exp((i - i % 2).cast("double") * F.lit(-math.log(10000.0) / width))
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i % 2 == 0, F.sin(pos * rate(i))).otherwise(F.cos(pos * rate(i))))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), one)

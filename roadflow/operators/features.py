"""Encoders, scalers and sequence windows.

A fitted encoder is a small DataFrame, joined back on; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fit_zscore(df: DataFrame, value: str) -> DataFrame:
    """One row (mean, scale): population deviation, 1 for a constant column."""
    sd = F.stddev_pop(value)
    return df.agg(F.avg(value).alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("scale"))


def zscore(df: DataFrame, value: str, fitted: DataFrame, out: str) -> DataFrame:
    """(value - mean) / scale; ``fitted`` is one row."""
    return df.crossJoin(F.broadcast(fitted)).withColumn(out, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def unzscore(df: DataFrame, scaled: str, fitted: DataFrame, out: str) -> DataFrame:
    return df.crossJoin(F.broadcast(fitted)).withColumn(out, F.col(scaled) * F.col("scale") + F.col("mean")).drop("mean", "scale")


def fit_minmax(train: DataFrame, value: str) -> DataFrame:
    """One row (low, span) of the training rows; a constant column has span 1."""
    span = F.max(value) - F.min(value)
    return train.agg(F.min(value).alias("low"), F.when(span == 0, F.lit(1.0)).otherwise(span).alias("span"))


def minmax(df: DataFrame, value: str, fitted: DataFrame, out: str) -> DataFrame:
    return df.crossJoin(F.broadcast(fitted)).withColumn(out, (F.col(value) - F.col("low")) / F.col("span")).drop("low", "span")


def unminmax(df: DataFrame, scaled: str, fitted: DataFrame, out: str) -> DataFrame:
    return df.crossJoin(F.broadcast(fitted)).withColumn(out, F.col(scaled) * F.col("span") + F.col("low")).drop("low", "span")


def fit_labels(df: DataFrame, value: str, code: str) -> DataFrame:
    """(value, code): sorted distinct values numbered from 0."""
    from roadflow.operators.ordering import number_rows

    classes = df.select(value).where(F.col(value).isNotNull()).distinct()
    return number_rows(classes, [value], code).withColumn(code, (F.col(code) - 1).cast("long"))


def class_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n): rows of each class, null among them."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def row_slice(df: DataFrame, order: list[str], first: int, size: int) -> DataFrame:
    """The rows first, first + 1, ... (from 0) of a total order, ``size`` of them at most."""
    from roadflow.operators.ordering import number_rows

    return number_rows(df, order, "_rn").where(F.col("_rn").between(first + 1, first + size)).drop("_rn")


def portable_hash(keys: list[str], seed: int = 42) -> Column:
    """A hash of the seed and the keys as texts, joined by bars, that any engine can compute: MD5 in hexadecimal. Null keys are left out."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if there are fewer) in the order of a hash of their keys; equal on every run."""
    return df.orderBy(portable_hash(keys, seed), *keys).limit(n)


def in_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """All rows with their place from 1 in a total order, written in that order."""
    from roadflow.operators.ordering import number_rows

    return number_rows(df, order, out).orderBy(out)


def encode(df: DataFrame, value: str, fitted: DataFrame, code: str) -> DataFrame:
    """Codes by a left join; an unknown value takes the code of the first class."""
    return df.join(fitted, value, "left").withColumn(code, F.coalesce(code, F.lit(0).cast("long")))


def one_hot(df: DataFrame, value: str, classes: list[str], prefix: str) -> DataFrame:
    """One 0/1 column for each class, named ``{prefix}_{class}``."""
    return df.select("*", *[F.when(F.col(value) == c, 1).otherwise(0).alias(f"{prefix}_{c}") for c in classes])


def windows(df: DataFrame, key: str, order: list[str], features: list[str], target: str, length: int = 24, ahead: int = 1, step: int = 4) -> DataFrame:
    """(key, start, x, y): every ``step``-th window of ``length`` rows of a key, its features, and the next ``ahead`` targets.

    Only windows with all rows are made; x is an array of feature arrays, y an array.  Rows are first put into blocks of ``step``, so a
    window is gathered once, from the few blocks that it spans, and none is made to be dropped.  Both steps keep the partitioning by key.
    """
    rows = df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)
    row = F.struct("_rn", F.array(*[F.col(c).cast("double") for c in features]).alias("f"), F.col(target).cast("double").alias("t"))
    blocks = rows.groupBy(key, F.floor(F.col("_rn") / step).alias("_block")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))  # ``step`` rows
    span = -(-(length + ahead) // step)
    w = W.partitionBy(key).orderBy("_block").rowsBetween(0, span - 1)
    made = blocks.select(key, "_block", F.flatten(F.collect_list("_rows").over(w)).alias("_rows")).where(F.size("_rows") >= length + ahead)
    part = lambda first, n, field: F.transform(F.slice("_rows", first, n), lambda r: r[field])
    return made.select(key, (F.col("_block") * step).cast("int").alias("start"), part(1, length, "f").alias("x"), part(length + 1, ahead, "t").alias("y"))


def lag_windows(df: DataFrame, order: list[str], value: str, lags: int = 12, key: str | None = None) -> DataFrame:
    """All columns, and lag_12 ... lag_1; rows with a full history only. Without a key the history crosses sites.

    Without a key the rows are ranged by the order, and each range gets the last rows before it, so no task sees them all.
    """
    if key is None:
        return _lags_across(df, order, value, lags)
    w = W.partitionBy(key).orderBy(*order)
    made = df.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(lags, 0, -1)], F.row_number().over(w).alias("_rn"))
    return made.where(F.col("_rn") > lags).drop("_rn")


def _lags_across(df: DataFrame, order: list[str], value: str, lags: int) -> DataFrame:
    from roadflow.operators.ordering import number_rows

    block = max(1000, lags)
    rows = number_rows(df, order, "_rn").withColumn("_block", F.floor((F.col("_rn") - 1) / block))
    tail = rows.where((F.col("_rn") - 1) % block >= block - lags).withColumn("_block", F.col("_block") + 1)  # seen again by the next block
    both = rows.withColumn("_own", F.lit(True)).unionByName(tail.withColumn("_own", F.lit(False)))
    w = W.partitionBy("_block").orderBy("_rn")
    made = both.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(lags, 0, -1)])
    return made.where(F.col("_own") & (F.col("_rn") > lags)).drop("_rn", "_block", "_own")


def last_before(df: DataFrame, key: str, ts: str, before: Column, order: list[str], n: int = 24) -> DataFrame:
    """The last n rows of each key strictly before a time, only for keys that have as many; ``age`` 1 is the latest."""
    w = W.partitionBy(key).orderBy(F.desc(ts), *[F.desc(c) for c in order])
    rows = df.where(F.col(ts) < before).withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
    return rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))).where(F.col("_n") == n).drop("_n")


def future_slots(ts: Column, n: int, minutes: int = 15) -> Column:
    """The next n times."""
    step = F.expr(f"interval {minutes} minutes")
    return F.sequence(ts + step, ts + F.expr(f"interval {minutes * n} minutes"), step)


def tail_split(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds ``is_test``: the last n rows of a total order.

    The rows are ranged by the order, counted by partition, and numbered from these counts; no single task sees all rows.
    """
    from roadflow.operators.ordering import number_rows

    total = df.count()
    return number_rows(df, order, "_rn").withColumn("is_test", F.col("_rn") > F.lit(total - n)).drop("_rn")


def hash_split(df: DataFrame, keys: list[str], share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: exactly int(share * n) rows, chosen by a hash of the keys."""
    from roadflow.operators.ordering import number_rows

    total = df.count()
    hashed = df.withColumn("_h", portable_hash(keys, seed))
    return number_rows(hashed, ["_h", *keys], "_rn").withColumn("is_train", F.col("_rn") <= F.lit(int(share * total))).drop("_rn", "_h")

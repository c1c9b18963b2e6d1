"""Forecast metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error over positive actual values."""
    return F.avg(F.when(actual > 0, F.abs(actual - predicted) / actual)) * 100


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, explained_variance, mae, mse, rmse, r2 over pairs without nulls."""
    y, p = F.col(actual), F.col(predicted)
    pairs = df.where(y.isNotNull() & p.isNotNull()).select(y.alias("y"), (y - p).alias("e"))
    spread = F.var_pop("y")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), (1 - F.var_pop("e") / spread).alias("explained_variance"), F.avg(F.abs("e")).alias("mae"),
        F.avg(F.col("e") * F.col("e")).alias("mse"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (1 - F.avg(F.col("e") * F.col("e")) / spread).alias("r2"),
    )


def batched(df: DataFrame, actual: str, predicted: str, batch: Column) -> DataFrame:
    """Mean over batches of each batch's squared and absolute error, beside the global ones."""
    e = F.col(actual) - F.col(predicted)
    per = df.where(e.isNotNull()).groupBy(batch.alias("batch")).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("se"), F.sum(F.abs(e)).alias("ae"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("mse").alias("batch_mse"), F.avg("mae").alias("batch_mae"), (F.sum("se") / F.sum("n")).alias("mse"), (F.sum("ae") / F.sum("n")).alias("mae"), F.sqrt(F.sum("se") / F.sum("n")).alias("rmse"))


def sampled(df: DataFrame, actual: str, predicted: str, keys: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """``regression`` over n rows picked by a hash of their keys (all, if there are fewer)."""
    from roadflow.operators.features import sample_rows

    return regression(sample_rows(df, keys, n, seed), actual, predicted)

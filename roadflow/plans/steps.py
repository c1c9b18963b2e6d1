"""Forecasts of several steps in columns: a daily profile and an autoregression of what it leaves, advanced by the clock.

The model is a handful of numbers (a mean for each hour, a weight for each lag).  A forecast folds over the next steps: each
takes the last values, gives the next one and puts it among them, and the clock goes on by a quarter of an hour.  All
sites are predicted in one plan without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.operators.features import lag_windows

DEFAULT = 500.0
MINUTES = 15


@dataclass
class ClockModel:
    """``profile``: mean by hour of the day; ``weights``: of the last value, the one before, ..."""

    profile: dict[int, float]
    mean: float
    weights: list[float]

    def usual(self, ts: Column) -> Column:
        """The profile at a time; an hour that was never seen has the mean of all."""
        if not self.profile:
            return F.lit(self.mean)
        pairs = [F.lit(x) for h, m in sorted(self.profile.items()) for x in (h, float(m))]
        return F.coalesce(F.create_map(*pairs)[F.hour(ts)], F.lit(float(self.mean)))


def fit_clock_model(series: DataFrame, key: str, ts: str, order: list[str], value: str, lags: int = 2) -> ClockModel:
    """Least squares without a constant for the deviations from the profile; rows without ``lags`` earlier ones of their site don't count.

    Two aggregations: means by hour (24 rows) and the sums of products of lags (one row).
    """
    means = series.groupBy(F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where("n > 0").collect()  # 24 rows at most
    total = sum(r["n"] for r in means)
    model = ClockModel({r["hour"]: r["mean"] for r in means if r["hour"] is not None}, sum(r["mean"] * r["n"] for r in means) / total if total else DEFAULT, [0.0] * lags)
    rest = series.where(F.col(value).isNotNull()).withColumn("_r", F.col(value) - model.usual(F.col(ts)))
    rows = lag_windows(rest, order, "_r", lags, key)
    names = ["_r", *[f"lag_{k}" for k in range(1, lags + 1)]]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    if sums[0] is None:
        return model
    square = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(1, lags + 1)] for i in range(1, lags + 1)])
    model.weights = np.linalg.lstsq(square, np.array([sums[f"p0_{i}"] for i in range(1, lags + 1)]), rcond=None)[0].tolist()
    return model


def advance(last: Column, weights: list[float], steps: int) -> Column:
    """The next ``steps`` values of an autoregression as an array; ``last``: the latest values, the latest one last."""
    lags = len(weights)

    def step(state: Column, _: Column) -> Column:
        following = sum((F.element_at(state["last"], -k) * w for k, w in enumerate(weights, 1)), F.lit(0.0))
        return F.struct(F.concat(F.slice(state["last"], 2, lags - 1) if lags > 1 else F.slice(state["last"], 1, 0), F.array(following)).alias("last"), F.concat(state["made"], F.array(following)).alias("made"))

    start = F.struct(last.alias("last"), F.array().cast("array<double>").alias("made"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda state: state["made"])


def forecast_steps(model: ClockModel, history: DataFrame, sites: DataFrame, key: str, ts: str, value: str, steps: int = 1, start: Column | None = None, age: str = "age", default: float = DEFAULT) -> DataFrame:
    """(key, step, ts, flow): the next ``steps`` flows of every site.

    ``history``: the last rows of each site, ``age`` 1 the latest (``features.last_before``).  The first step is a quarter of an
    hour after the latest row, or after ``start``.  Sites with too few rows get the default, and a null time without a start.
    """
    lags = len(model.weights)
    rest = history.where(F.col(age).between(1, lags)).select(key, F.col(age).alias("_age"), F.col(ts).alias("_ts"), (F.col(value) - model.usual(F.col(ts))).alias("_r"))
    last = rest.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_age")).alias("place"), "_r"))), lambda x: x["_r"]).alias("_last"), F.max("_ts").alias("_from"))  # ``lags`` rows of a site
    full = last.where((F.size("_last") == lags) & ~F.exists("_last", lambda x: x.isNull()))
    rows = sites.select(key).distinct().join(full, key, "left").withColumn("_made", F.when(F.col("_last").isNotNull(), advance(F.col("_last"), model.weights, steps)))
    begin = start if start is not None else F.col("_from")
    each = rows.select(key, begin.alias("_begin"), "_made", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    when = F.expr(f"_begin + make_dt_interval(0, 0, step * {MINUTES})")
    made = each.withColumn(ts, when)
    return made.select(key, F.col("step").cast("long").alias("step"), ts, F.coalesce(model.usual(F.col(ts)) + F.element_at("_made", F.col("step")), F.lit(default)).alias("flow"))


def predict_flow(series: DataFrame, key: str, ts: str, order: list[str], value: str, site, at: str, num_steps: int = 1, lags: int = 2) -> list[float]:
    """The flows of one site for the quarters of an hour from a time on: the service call.  Only rows before the time are used."""
    from roadflow.operators.features import last_before

    kind = dict(series.dtypes)[ts]
    before = series.where(F.col(ts) < F.lit(at).cast(kind))
    model = fit_clock_model(before, key, ts, [ts, *order], value, lags)
    mine = before.where(F.col(key) == F.lit(site))
    one = series.sparkSession.createDataFrame([(site,)], f"{key} {dict(series.dtypes)[key]}")
    start = F.expr(f"cast('{at}' as {kind}) - interval {MINUTES} minutes")
    made = forecast_steps(model, last_before(mine, key, ts, F.lit(at).cast(kind), order, lags), one, key, ts, value, num_steps, start)
    return [r["flow"] for r in made.orderBy("step").collect()]  # one row for each step

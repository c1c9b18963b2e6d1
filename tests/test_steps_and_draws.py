"""Forecasts of several steps against a plain loop, and weighted draws against running sums."""

from __future__ import annotations

import bisect
import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.operators import draws
from roadflow.operators.draws import running_sums, weighted_draws
from roadflow.operators.features import last_before
from roadflow.plans.steps import advance, fit_clock_model, forecast_steps, predict_flow

SERIES = "site string, ts timestamp_ntz, id long, value double"


def _series():
    rng, rows = random.Random(3), []
    for site in "abc":
        level = 0.0
        for i in range(90):
            level = 0.6 * level - 0.2 * rng.random() + rng.gauss(0, 1)
            ts = datetime(2024, 1, 1) + timedelta(minutes=15 * i)
            rows.append((site, ts, i, 50.0 + 10 * ts.hour + level))
    return rows


def _by_hand(rows, lags, steps, sites):
    hours = {}
    for _, ts, _, v in rows:
        hours.setdefault(ts.hour, []).append(v)
    usual = {h: float(np.mean(v)) for h, v in hours.items()}
    overall = float(np.mean([r[3] for r in rows]))
    rest = {}
    for site, ts, _, v in sorted(rows, key=lambda r: r[:3]):
        rest.setdefault(site, []).append((ts, v - usual[ts.hour]))
    x, y = [], []
    for held in rest.values():
        for i in range(lags, len(held)):
            x.append([held[i - k][1] for k in range(1, lags + 1)])
            y.append(held[i][1])
    weights = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
    out = {}
    for site in sites:
        held = [r for _, r in rest.get(site, [])]
        for k in range(1, steps + 1):
            if len(rest.get(site, [])) < lags:
                out[site, k] = 500.0
                continue
            held.append(sum(w * held[-i] for i, w in enumerate(weights, 1)))
            due = rest[site][-1][0] + timedelta(minutes=15 * k)
            out[site, k] = usual.get(due.hour, overall) + held[-1]
    return weights, out


@pytest.mark.parametrize(("lags", "steps"), [(1, 3), (5, 9)])
def test_steps(spark, lags, steps):
    rows = _series() + [("short", datetime(2024, 1, 1), 0, 60.0)] * (lags > 1)
    df = spark.createDataFrame(rows, SERIES)
    model = fit_clock_model(df, "site", "ts", ["ts", "id"], "value", lags)
    weights, want = _by_hand(rows, lags, steps, ["a", "b", "c", "short", "none"] if lags > 1 else ["a", "b", "c", "none"])
    np.testing.assert_allclose(model.weights, weights, rtol=1e-6)
    history = last_before(df, "site", "ts", F.lit("2030-01-01").cast("timestamp_ntz"), ["id"], lags)
    every = spark.createDataFrame([(s,) for s in {s for s, _ in want}], "site string")
    got = {(r["site"], r["step"]): r for r in forecast_steps(model, history, every, "site", "ts", "value", steps).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r["flow"] for k, r in got.items()}
    assert got["a", 2]["ts"] - got["a", 1]["ts"] == timedelta(minutes=15) and got["none", 1]["ts"] is None


def test_service_call(spark):
    rows = _series()
    df = spark.createDataFrame(rows, SERIES)
    at = datetime(2024, 1, 1, 15)
    before = [r for r in rows if r[1] < at]
    _, want = _by_hand(before, 2, 4, ["b"])
    assert predict_flow(df, "site", "ts", ["id"], "value", "b", "2024-01-01 15:00:00", 4) == [pytest.approx(want["b", k]) for k in range(1, 5)]
    assert predict_flow(df, "site", "ts", ["id"], "value", "nobody", "2024-01-01 15:00:00", 2) == [500.0, 500.0]


def test_advance(spark):
    made = spark.range(1).select(advance(F.array(F.lit(1.0), F.lit(2.0)), [0.5, 2.0], 3).alias("m")).first()["m"]
    assert made == [3.0, 5.5, 8.75]


def _items():
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, -3, 40])) for i in range(300)]
    return [*rows, (300, None), (301, 9000)]


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_draws(spark, monkeypatch, most):
    """One item has over half of the weight, so half of the draws fall into one range, which is split."""
    monkeypatch.setattr(draws, "MOST_DRAWS", most)
    items, den = _items(), 1009
    known = [(i, w) for i, w in items if w and w > 0]
    upto = list(itertools.accumulate(w for _, w in known))
    asked = [(k, (k * 7919) % den) for k in range(600)] + [(600, None), (601, den), (602, -1), (603, 0), (603, 0), (604, den - 1)]
    want = sorted((k, n, known[bisect.bisect_right(upto, upto[-1] * n // den)][0]) for k, n in asked if n is not None and 0 <= n < den)
    df = spark.createDataFrame(items, "item long, weight long").repartition(5)
    got = weighted_draws(df, "weight", ["item"], spark.createDataFrame(asked, "k long, num long"), "num", den)
    assert got.columns == ["k", "num", "item"]
    assert sorted(map(tuple, got.collect())) == want


def test_draws_from_nothing_and_large_weights(spark):
    asked = spark.createDataFrame([(1, 0), (2, 1)], "k long, num long")
    assert weighted_draws(spark.createDataFrame([(1, 0)], "item long, weight long"), "weight", ["item"], asked, "num", 3).collect() == []
    big = 1 << 61
    df = spark.createDataFrame([(1, big), (2, big - 1)], "item long, weight long")
    total, den = 2 * big - 1, 2_000_000_011
    nums = [0, den // 2 - 1, den // 2, den // 2 + 1, den - 1]
    got = weighted_draws(df, "weight", ["item"], spark.createDataFrame([(n, n) for n in nums], "k long, num long"), "num", den)
    assert sorted((r["k"], r["item"]) for r in got.collect()) == [(n, 1 if total * n // den < big else 2) for n in nums]


def test_running_sums(spark):
    rows, ranges = running_sums(spark.createDataFrame(_items(), "item long, weight long"), "weight", ["item"], "upto")
    known = [(i, w) for i, w in _items() if w and w > 0]
    assert sorted((r["item"], r["upto"]) for r in rows.collect()) == list(zip([i for i, _ in known], itertools.accumulate(w for _, w in known)))
    assert ranges[-1][2] == sum(w for _, w in known)

"""Training of the forecaster: slopes against differences, sums against one machine, rules by hand, search against full evaluation."""

from __future__ import annotations

import numpy as np
import pytest

from roadflow.plans import training
from roadflow.plans.forecast import forward
from roadflow.plans.training import Running, Trial, as_weights, loss_and_slopes, run_trials, search_settings, shapes, start_weights, sum_slopes, to_end, train_network, training_rows
from roadflow.scratch import Rounds

FIELDS = "site long, start long, x array<array<double>>, y array<double>"


def _windows(spark, n=240, steps=6, inputs=3, seed=1):
    """Targets are a mix of the last two values of the first input."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, steps, inputs))
    y = 0.7 * x[:, -1, 0] - 0.4 * x[:, -2, 0]
    return spark.createDataFrame([(i % 7, i, x[i].tolist(), [float(y[i])]) for i in range(n)], FIELDS), x, y


@pytest.mark.parametrize("trial", [Trial(16, 2, 5, 2), Trial(8, 1, 4, 1), Trial(8, 1, 4, 0)])
def test_slopes_against_differences(trial):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5, 4, 3)), rng.normal(size=5)
    flat = start_weights(trial, 3) + rng.normal(size=len(start_weights(trial, 3))) * 0.1
    loss, slopes = loss_and_slopes(flat, trial, x, y)
    assert loss == pytest.approx(float(((forward(x, as_weights(flat, trial, 3), trial.heads) - y) ** 2).sum()))
    for i in range(0, len(flat), 1 if len(flat) < 400 else 7):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        about = (loss_and_slopes(up, trial, x, y, False)[0] - loss_and_slopes(down, trial, x, y, False)[0]) / 2e-5
        assert slopes[i] == pytest.approx(about, rel=1e-4, abs=1e-6)


def test_sums_over_tasks(spark, monkeypatch):
    """Slopes summed in a tree over many tasks are those of one machine, for every trial, whatever the tasks."""
    monkeypatch.setattr(training, "ROWS", 16)
    windows, x, y = _windows(spark)
    rows = training_rows(windows.repartition(9), Rounds(spark, "test"), 1, 0.25)
    trials = {0: (Trial(), start_weights(Trial(), 3)), 4: (Trial(8, 1, 3), start_weights(Trial(8, 1, 3), 3))}
    got = sum_slopes(rows.repartition(17), trials)
    held = np.array([r["y"] for r in rows.where("part = -1").collect()])
    known = ~np.isin(y, held)
    assert 0 < len(held) < len(y) / 2
    for k, (trial, w) in trials.items():
        loss, slopes = loss_and_slopes(w, trial, x[known], y[known])
        assert (got[k]["n"], got[k]["val_n"]) == (known.sum(), len(held))
        assert got[k]["loss"] == pytest.approx(loss) and got[k]["val_loss"] == pytest.approx(loss_and_slopes(w, trial, x[~known], y[~known], False)[0])
        np.testing.assert_allclose(got[k]["slopes"], slopes, rtol=1e-9, atol=1e-9)


def test_rules():
    run = Running(Trial(rate=0.1), np.zeros(4), 0.1)
    assert run.step(np.array([300.0, 400.0, 0, 0]), 1) and np.allclose(run.weights, [-0.1, -0.1, 0, 0], atol=1e-6)  # a first step of Adam is the rate
    assert np.allclose(run.first, 0.1 * np.array([0.6, 0.8, 0, 0]), atol=1e-6)  # the norm was clipped to 1
    before = run.weights
    assert not run.step(np.array([np.nan, 0, 0, 0]), 1) and run.weights is before
    for epoch, loss in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 3.0, 9.0], 1):
        run.judge(epoch, 0.0, loss, np.full(4, loss), 2)
    assert (run.best, run.best_weights[0], run.rate, run.bad) == (3.0, 3.0, 0.05, 1)
    assert [h[3] for h in run.history] == [0.1] * 5 + [0.05] * 2
    assert to_end({0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}, {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}, 1) == [3, 2]
    assert to_end({0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}, {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}, 3) == [3]
    assert [Trial(16, 2).allowed(), Trial(16, 4).allowed(), Trial(64, 8).allowed(), Trial(24, 5).allowed()] == [True, False, True, False]


def test_training_learns_and_keeps_the_best(spark):
    windows, x, y = _windows(spark)
    weights, history = train_network(windows, Trial(rate=0.02, seed=2), epochs=6, slices=2, validation=0.2)
    rows = sorted(map(tuple, history.collect()))
    assert [r[1] for r in rows] == list(range(1, 7))
    assert rows[-1][2] < 0.8 * rows[0][2]
    # the weights are those of the epoch with the lowest loss on the validation rows
    held = np.array([r["y"] for r in training_rows(windows, Rounds(spark, "test"), 2, 0.2).where("part = -1").collect()])
    at = np.isin(y, held)
    assert float(((forward(x[at], weights, 2) - y[at]) ** 2).mean()) == pytest.approx(min(r[3] for r in rows))
    known = {n: s for n, s in shapes(Trial(), 3).items()}
    assert weights["embed"].shape == known["embed"] and len(weights["layers"]) == 1


def test_search_against_full_evaluation(spark):
    """Ended trials are worse than the five that are kept, and those are the five of a search that ends none."""
    windows, _, _ = _windows(spark, 160)
    trials = [Trial(8, 1, 8, 1, rate) for rate in (0.03, 0.02, 0.01, 0.008, 0.005, 1e-6, 1e-7, 1e-8)] + [Trial(8, 3)]
    whole, _ = search_settings(windows, trials, epochs=4, warm_up=None, validation=0.2)
    ended, best = search_settings(windows, trials, epochs=4, warm_up=1, validation=0.2)
    told = lambda t: {r["trial"]: (r["state"], r["epochs"], r["rank"]) for r in t.collect()}
    a, b = told(whole), told(ended)
    assert {s for s, _, _ in a.values()} == {"complete", "rejected"} and b[8] == ("rejected", 0, 9)
    assert sum(s == "pruned" for s, _, _ in b.values()) == 3 and all(e < 4 for s, e, _ in b.values() if s == "pruned")
    first = lambda t: sorted(t, key=lambda i: t[i][2])[:5]
    assert first(a) == first(b) and len(best) == 5
    losses = {r["trial"]: r["best_loss"] for r in whole.collect()}
    assert losses[8] is None and all(losses[i] == pytest.approx(r["best_loss"]) for r in ended.collect() for i in [r["trial"]] if r["state"] == "complete")


def test_no_windows(spark):
    with pytest.raises(ValueError, match="no windows"):
        train_network(spark.createDataFrame([], FIELDS), Trial())


def test_no_validation_rows(spark):
    windows, _, _ = _windows(spark, 30)
    rows = training_rows(windows, Rounds(spark, "test"), 1, 0.0)
    one = run_trials(rows, [Trial(8, 1, 4)], 3, 2)[0]
    assert one.state == "complete" and [h[1] for h in one.history] == [h[2] for h in one.history]


def test_trials_of_equal_weights_are_summed_once(spark):
    """Trials that differ in their rate start from the same weights: one sum for all of them, and the same sums as alone."""
    windows, _, _ = _windows(spark, 40)
    rows = training_rows(windows, Rounds(spark, "test"), 1, 0.2)
    inputs = 3
    trials = {0: Trial(8, 1, 4, rate=0.1), 1: Trial(8, 1, 4, rate=0.01), 2: Trial(8, 1, 8)}
    weighed = {k: (t, start_weights(t, inputs)) for k, t in trials.items()}
    weighed[3] = (trials[1], weighed[1][1] + 1)
    together = sum_slopes(rows, weighed)
    assert sorted(together) == [0, 1, 2, 3] and together[0] is together[1] and together[1] is not together[3]
    for k in weighed:
        alone = sum_slopes(rows, {k: weighed[k]})[k]
        assert alone["n"] == together[k]["n"] and alone["loss"] == pytest.approx(together[k]["loss"]) and alone["slopes"] == pytest.approx(together[k]["slopes"])

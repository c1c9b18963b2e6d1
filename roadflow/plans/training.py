"""Training of the attention forecaster on windows, data-parallel, and a search over its settings.

The windows are a written table, dealt into slices.  A step is one job over one slice: each task sums the slopes of its
rows for every trial that is still running, the sums are added in a tree, and the driver holds one vector for each trial.  It
clips it, takes a step of Adam and sends the new weights with the next job.  So its memory is some vectors for each trial, whatever the
number of windows, and a lost executor costs the rows of its tasks.

Trials run in step with each other, one pass over the windows for all of them.  After the warm-up a trial ends early if its best loss is above the
median of the others at that epoch, as long as ``kept`` are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.scratch import Rounds
from roadflow.session import ship

#: Fixed values of Adam, of the plateau rule and of clipping.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
FACTOR, MOST_NORM = 0.5, 1.0
#: Rows of a slice that one product takes; few, so that what they make stays in the cache.
ROWS = 64

HISTORY = "trial int, epoch int, train_loss double, val_loss double, rate double"
SLOPES = "trial int, node int, n long, loss double, val_n long, val_loss double, slopes binary"


@dataclass
class Trial:
    """Settings of one training run. ``heads`` must divide ``width`` into parts of eight at least."""

    width: int = 16
    heads: int = 2
    inner: int = 32
    layers: int = 1
    rate: float = 1e-3
    decay: float = 0.0
    seed: int = 0

    def allowed(self) -> bool:
        return self.width % self.heads == 0 and self.heads <= self.width // 8


def shapes(trial: Trial, inputs: int) -> dict[str, tuple[int, ...]]:
    d, k = trial.width, trial.inner
    out: dict[str, tuple[int, ...]] = {"embed": (inputs, d)}
    for i in range(trial.layers):
        out |= {f"{i}.{n}": (d, d) for n in ("wq", "wk", "wv", "wo")}
        out |= {f"{i}.w1": (d, k), f"{i}.b1": (k,), f"{i}.w2": (k, d), f"{i}.b2": (d,)}
        out |= {f"{i}.{n}": (d,) for n in ("g1", "s1", "g2", "s2")}
    return out | {"head": (d,)}


def views(flat: np.ndarray, known: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The named arrays in one vector, without copies."""
    out, at = {}, 0
    for name, shape in known.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start_weights(trial: Trial, inputs: int) -> np.ndarray:
    """Uniform by fan-in and fan-out; gains 1, shifts 0."""
    rng, known = np.random.default_rng(trial.seed), shapes(trial, inputs)
    flat = np.zeros(sum(map(math.prod, known.values())))
    for name, w in views(flat, known).items():
        if name[-2:] in ("g1", "g2"):
            w[:] = 1
        elif w.ndim == 2 or name == "head":
            w[:] = rng.uniform(-1, 1, w.shape) * math.sqrt(6 / (w.shape[0] + (w.shape[1] if w.ndim == 2 else 1)))
    return flat


def as_weights(flat: np.ndarray, trial: Trial, inputs: int) -> dict:
    """The form that ``forecast.forward`` takes."""
    named = views(flat, shapes(trial, inputs))
    layers = [{n.split(".")[1]: w for n, w in named.items() if n.startswith(f"{i}.")} for i in range(trial.layers)]
    return {"embed": named["embed"], "layers": layers, "head": named["head"]}


def _norm(x, gain, shift):
    part = 1 / x.shape[-1]
    z = x - np.einsum("ntd->nt", x)[..., None] * part
    inverse = 1 / np.sqrt(np.einsum("ntd,ntd->nt", z, z)[..., None] * part + 1e-5)
    z *= inverse
    return z * gain + shift, z, inverse


def _norm_back(dy, z, inverse, gain):
    dz, part = dy * gain, 1 / dy.shape[-1]
    along = dz - np.einsum("ntd->nt", dz)[..., None] * part - z * (np.einsum("ntd,ntd->nt", dz, z)[..., None] * part)
    return inverse * along, np.einsum("ntd,ntd->d", dy, z), np.einsum("ntd->d", dy)


def loss_and_slopes(flat: np.ndarray, trial: Trial, x: np.ndarray, y: np.ndarray, slopes: bool = True) -> tuple[float, np.ndarray | None]:
    """(sum of squared errors of the windows, its slopes): x is windows x steps x inputs."""
    known = shapes(trial, x.shape[2])
    w, (n, t, _) = views(flat, known), x.shape
    heads, part = trial.heads, trial.width // trial.heads
    split = lambda a: a.reshape(n, t, heads, part).transpose(0, 2, 1, 3)
    joined = lambda a: a.transpose(0, 2, 1, 3).reshape(n, t, trial.width)
    outer = lambda a, b: a.reshape(n * t, -1).T @ b.reshape(n * t, -1)
    times = lambda a, w: (a.reshape(n * t, -1) @ w).reshape(n, t, -1)
    future = np.triu(np.full((t, t), -1e9), 1)
    h, kept = times(x, w["embed"]), []
    for i in range(trial.layers):
        p = {k: w[f"{i}.{k}"] for k in ("wq", "wk", "wv", "wo", "w1", "b1", "w2", "b2", "g1", "s1", "g2", "s2")}
        a, z1, r1 = _norm(h, p["g1"], p["s1"])
        q, k, v = (split(times(a, p[m])) for m in ("wq", "wk", "wv"))
        share = (q / math.sqrt(part)) @ k.swapaxes(-1, -2)
        share += future
        share -= share.max(-1, keepdims=True)
        np.exp(share, out=share)
        share /= np.einsum("hist->his", share)[..., None]
        seen = joined(share @ v)
        h = h + times(seen, p["wo"])
        b, z2, r2 = _norm(h, p["g2"], p["s2"])
        u = times(b, p["w1"]) + p["b1"]
        h = h + times(np.maximum(u, 0), p["w2"]) + p["b2"]
        kept.append((p, a, z1, r1, q, k, v, share, seen, b, z2, r2, u))
    pooled = h.mean(1)
    error = pooled @ w["head"] - y
    loss = float((error**2).sum())
    if not slopes:
        return loss, None
    out = np.zeros_like(flat)
    g = views(out, known)
    g["head"][:] = 2 * error @ pooled
    dh = np.repeat((2 * error[:, None] * w["head"] / t)[:, None, :], t, axis=1)
    for i in reversed(range(trial.layers)):
        p, a, z1, r1, q, k, v, share, seen, b, z2, r2, u = kept[i]
        g[f"{i}.b2"][:], g[f"{i}.w2"][:] = dh.sum((0, 1)), outer(np.maximum(u, 0), dh)
        du = times(dh, p["w2"].T) * (u > 0)
        g[f"{i}.b1"][:], g[f"{i}.w1"][:] = du.sum((0, 1)), outer(b, du)
        back, g[f"{i}.g2"][:], g[f"{i}.s2"][:] = _norm_back(times(du, p["w1"].T), z2, r2, p["g2"])
        dh = dh + back
        g[f"{i}.wo"][:] = outer(seen, dh)
        dseen = split(times(dh, p["wo"].T))
        dshare = dseen @ v.swapaxes(-1, -2)
        dshare -= np.einsum("hist,hist->his", dshare, share)[..., None]
        dshare *= share
        dscore = dshare
        dscore /= math.sqrt(part)
        dq, dk, dv = joined(dscore @ k), joined(dscore.swapaxes(-1, -2) @ q), joined(share.swapaxes(-1, -2) @ dseen)
        for m, d in (("wq", dq), ("wk", dk), ("wv", dv)):
            g[f"{i}.{m}"][:] = outer(a, d)
        back, g[f"{i}.g1"][:], g[f"{i}.s1"][:] = _norm_back(times(dq, p["wq"].T) + times(dk, p["wk"].T) + times(dv, p["wv"].T), z1, r1, p["g1"])
        dh = dh + back
    g["embed"][:] = outer(x, dh)
    return loss, out


def training_rows(windows: DataFrame, rounds: Rounds, slices: int = 1, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """The written windows (x, y) with ``part``: a slice from 0 on, or -1 for validation; by a hash of key and start.

    The table is partitioned by it, so a step reads its own slice only.
    """
    key = F.xxhash64(windows.columns[0], "start", F.lit(seed))
    part = F.when(F.pmod(key, F.lit(10_000)) < int(10_000 * validation), -1).otherwise(F.pmod(F.shiftright(key, 20), F.lit(slices)))
    rows = windows.select("x", F.element_at("y", 1).cast("double").alias("y"), part.cast("int").alias("part"))
    rounds.n += 1
    path = f"{rounds.root}/{rounds.n}"
    rows.write.partitionBy("part").parquet(path)
    return windows.sparkSession.read.schema(rows.schema).parquet(path)


def _add(table: pa.Table) -> pa.Table:
    """One row of sums for each trial and node."""
    first = table.slice(0, 1)
    sums = {c: [sum(table[c].to_pylist())] for c in ("n", "loss", "val_n", "val_loss")}
    slopes = sum(np.frombuffer(v.as_py()) for v in table["slopes"])
    return pa.table({"trial": first["trial"], "node": first["node"], "n": pa.array(sums["n"], pa.int64()), "loss": sums["loss"], "val_n": pa.array(sums["val_n"], pa.int64()), "val_loss": sums["val_loss"], "slopes": [slopes.tobytes()]})


def sum_slopes(rows: DataFrame, trials: dict[int, tuple[Trial, np.ndarray]]) -> dict[int, dict]:
    """For each trial (n, loss, val_n, val_loss, slopes) over all rows, added in a tree of two levels; validation rows give no slopes.

    Trials of one network and equal weights, as at the start of those that differ in their rate, are summed once.
    """
    ship(rows.sparkSession)
    alike = {k: (t.width, t.heads, t.inner, t.layers, w.tobytes()) for k, (t, w) in trials.items()}
    first = {}
    for k, same in alike.items():
        first.setdefault(same, k)
    sent = {k: trials[k] for k in first.values()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: [0, 0.0, 0, 0.0, np.zeros_like(w)] for k, (_, w) in sent.items()}
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                x = batch.column("x")
                inner = x.flatten()
                x = inner.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(inner) // len(x), -1)
                y, part = batch.column("y").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)
                known = part >= 0
                for k, (trial, w) in sent.items():
                    if known.any():
                        loss, slopes = loss_and_slopes(w, trial, x[known], y[known])
                        total[k][0] += int(known.sum())
                        total[k][1] += loss
                        total[k][4] += slopes
                    if not known.all():
                        total[k][2] += int((~known).sum())
                        total[k][3] += loss_and_slopes(w, trial, x[~known], y[~known], False)[0]
        for k, (n, loss, m, other, slopes) in total.items():
            if n or m:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([loss]), pa.array([m], pa.int64()), pa.array([other]), pa.array([slopes.tobytes()])], ["trial", "node", "n", "loss", "val_n", "val_loss", "slopes"])

    sums = rows.select("x", "y", "part").mapInArrow(run, SLOPES)
    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    if fan > 1:
        sums = sums.withColumn("node", (F.spark_partition_id() % fan).cast("int")).groupBy("trial", "node").applyInArrow(_add, SLOPES)
    found = sums.withColumn("node", F.lit(0)).groupBy("trial").applyInArrow(_add, SLOPES).collect()  # one vector for each trial
    known = {r["trial"]: {"n": r["n"], "loss": r["loss"], "val_n": r["val_n"], "val_loss": r["val_loss"], "slopes": np.frombuffer(bytes(r["slopes"]))} for r in found}
    return {k: known[first[same]] for k, same in alike.items() if first[same] in known}


@dataclass
class Running:
    """The state of one trial on the driver: weights, the moments of Adam, and what plateau and checkpoint rules need."""

    trial: Trial
    weights: np.ndarray
    rate: float
    first: np.ndarray = None
    second: np.ndarray = None
    steps: int = 0
    best: float = math.inf
    best_weights: np.ndarray = None
    bad: int = 0
    state: str = "running"
    history: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.first, self.second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        self.best_weights = self.weights.copy()

    def step(self, slopes: np.ndarray, n: int) -> bool:
        """One step of Adam on the mean slopes, clipped to a norm; slopes that are no numbers are left out."""
        slopes = slopes / max(n, 1)
        if not np.isfinite(slopes).all():
            return False
        norm = float(np.sqrt((slopes**2).sum()))
        slopes = slopes * min(1.0, MOST_NORM / (norm + 1e-6)) + self.trial.decay * self.weights
        self.steps += 1
        self.first = BETA1 * self.first + (1 - BETA1) * slopes
        self.second = BETA2 * self.second + (1 - BETA2) * slopes**2
        ahead, spread = self.first / (1 - BETA1**self.steps), self.second / (1 - BETA2**self.steps)
        self.weights = self.weights - self.rate * ahead / (np.sqrt(spread) + EPSILON)
        return True

    def judge(self, epoch: int, train_loss: float, val_loss: float, weights: np.ndarray, patience: int) -> None:
        """Keep the best weights; halve the rate after more than ``patience`` epochs in a row without a better loss."""
        self.history.append((epoch, train_loss, val_loss, self.rate))
        if val_loss < self.best:
            self.best, self.best_weights, self.bad = val_loss, weights.copy(), 0
        else:
            self.bad += 1
            if self.bad > patience:
                self.rate, self.bad = self.rate * FACTOR, 0


def run_trials(rows: DataFrame, trials: list[Trial], inputs: int, epochs: int, slices: int = 1, patience: int = 5, warm_up: int | None = None, kept: int = 5) -> list[Running]:
    """Train all trials; an epoch is one job for each slice, and one over the validation rows with the weights that it ends with.

    ``warm_up``: epochs before trials are ended early (None: never).  Without validation rows the training loss is judged.
    """
    running = [Running(t, start_weights(t, inputs) if t.allowed() else np.zeros(1), t.rate, state="running" if t.allowed() else "rejected") for t in trials]
    valid = F.col("part") == -1
    for epoch in range(1, epochs + 1):
        alive = {i: r for i, r in enumerate(running) if r.state == "running"}
        if not alive:
            break
        train = {i: [0, 0.0] for i in alive}
        for s in range(slices):
            now = sum_slopes(rows.where(F.col("part") == s), {i: (r.trial, r.weights) for i, r in alive.items()})
            for i, sums in now.items():
                train[i][0] += sums["n"]
                train[i][1] += sums["loss"]
                alive[i].step(sums["slopes"], sums["n"])
        losses = sum_slopes(rows.where(valid), {i: (r.trial, r.weights) for i, r in alive.items()})
        for i, r in alive.items():
            loss = losses[i]["val_loss"] / losses[i]["val_n"] if i in losses else train[i][1] / max(train[i][0], 1)
            r.judge(epoch, train[i][1] / max(train[i][0], 1), loss if math.isfinite(loss) else math.inf, r.weights, patience)
        if warm_up is not None and epoch > warm_up and epoch < epochs:
            for i in to_end({i: r.best for i, r in alive.items()}, {i: r.history[-1][2] for i, r in alive.items()}, kept):
                running[i].state = "pruned"
    for r in running:
        if r.state == "running":
            r.state = "complete"
    return running


def to_end(best: dict[int, float], now: dict[int, float], kept: int) -> list[int]:
    """The trials whose best loss is above the median of all losses of this epoch, the worst first, while more than ``kept`` are left."""
    median = float(np.median(list(now.values())))
    worse = sorted((i for i in best if best[i] > median), key=lambda i: -best[i])
    return worse[: max(0, len(best) - kept)]


def train_network(windows: DataFrame, trial: Trial, epochs: int = 10, slices: int = 1, validation: float = 0.1, patience: int = 5) -> tuple[dict, DataFrame]:
    """(best weights as ``forecast.forward`` takes them, history): see ``run_trials``. Windows: key, start, x, y."""
    found, history, inputs = _run(windows, [trial], epochs, slices, validation, patience, None, 1)
    return as_weights(found[0].best_weights, trial, inputs), history


def search_settings(windows: DataFrame, trials: list[Trial], epochs: int = 10, slices: int = 1, validation: float = 0.1, patience: int = 3, warm_up: int | None = 5, kept: int = 5) -> tuple[DataFrame, list[tuple[Trial, dict]]]:
    """((trial, rank, state, epochs, best_loss), the ``kept`` best trials with their weights, the best first).

    Settings that are not allowed are ``rejected`` with no epoch; equal losses rank by the trial's number.
    """
    found, _, inputs = _run(windows, trials, epochs, slices, validation, patience, warm_up, kept)
    order = sorted(range(len(found)), key=lambda i: (found[i].best, i))
    rank = {i: n for n, i in enumerate(order, 1)}
    rows = [(i, rank[i], r.state, len(r.history), r.best if math.isfinite(r.best) else None) for i, r in enumerate(found)]
    table = windows.sparkSession.createDataFrame(rows, "trial int, rank int, state string, epochs int, best_loss double")
    return table, [(found[i].trial, as_weights(found[i].best_weights, found[i].trial, inputs)) for i in order[:kept] if math.isfinite(found[i].best)]


def _run(windows: DataFrame, trials: list[Trial], epochs: int, slices: int, validation: float, patience: int, warm_up: int | None, kept: int):
    spark: SparkSession = windows.sparkSession
    rows = training_rows(windows, Rounds(spark, "training"), slices, validation)
    one = rows.select(F.size(F.element_at("x", 1)).alias("inputs")).first()
    if one is None:
        raise ValueError("no windows to train on")
    found = run_trials(rows, trials, one["inputs"], epochs, slices, patience, warm_up, kept)
    history = [(i, *h) for i, r in enumerate(found) for h in r.history]
    return found, spark.createDataFrame(history, HISTORY), one["inputs"]

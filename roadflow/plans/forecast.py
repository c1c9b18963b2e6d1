"""Flow forecasts: linear regression on lags, grid search, batch prediction with a default.

Also the forward pass of an attention encoder and decoder in numpy, for weights trained elsewhere.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.operators.features import lag_windows
from roadflow.session import ship

LAGS = 12


def _assembled(df: DataFrame, lags: int) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[f"lag_{k}" for k in range(lags, 0, -1)], outputCol="features").transform(df)


def train(series: DataFrame, key: str, order: list[str], value: str, lags: int = LAGS, penalty: float = 0.0):
    """A regression of a value on its last values at the same site."""
    from pyspark.ml.regression import LinearRegression

    rows = lag_windows(series, order, value, lags, key)
    return LinearRegression(labelCol=value, regParam=penalty).fit(_assembled(rows, lags))


def search(series: DataFrame, key: str, order: list[str], value: str, lags: int = LAGS, penalties: tuple[float, ...] = (0.0, 0.1, 1.0), seed: int = 42):
    """(best model, error of each penalty) by a train and validation split."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    line = LinearRegression(labelCol=value)
    grid = ParamGridBuilder().addGrid(line.regParam, list(penalties)).build()
    rows = _assembled(lag_windows(series, order, value, lags, key), lags)
    model = TrainValidationSplit(estimator=line, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=value), trainRatio=0.7, seed=seed, parallelism=2).fit(rows)
    return model.bestModel, dict(zip(penalties, model.validationMetrics))


def predict_sites(model, history: DataFrame, sites: DataFrame, key: str, value: str, age: str = "age", lags: int = LAGS, default: float = 500.0) -> DataFrame:
    """(key, flow): a prediction for every site in one job; sites without enough history get the default.

    ``history``: the last rows of each site with ``age`` 1 for the latest.
    """
    wide = history.where(F.col(age) <= lags).groupBy(key).agg(*[F.max(F.when(F.col(age) == k, F.col(value))).alias(f"lag_{k}") for k in range(lags, 0, -1)]).dropna()
    made = model.transform(_assembled(wide, lags)).select(key, F.col("prediction").alias("_p"))
    return sites.select(key).join(made, key, "left").select(key, F.coalesce("_p", F.lit(default)).alias("flow"))


def save_metadata(spark: SparkSession, path: str, **values) -> None:
    """Model metadata as one JSON row."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "metadata string").write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


# --- attention ---------------------------------------------------------------


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool = False) -> np.ndarray:
    """Scaled dot-product attention over the last two axes."""
    score = q @ np.swapaxes(k, -1, -2) / math.sqrt(q.shape[-1])
    if causal:
        score = np.where(np.tril(np.ones(score.shape[-2:], bool)), score, -1e9)
    score = np.exp(score - score.max(-1, keepdims=True))
    return score / score.sum(-1, keepdims=True) @ v


def _norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * gain + shift


def encoder_layer(x: np.ndarray, w: dict[str, np.ndarray], heads: int, causal: bool = True) -> np.ndarray:
    """Pre-norm self-attention and feed-forward. w: wq wk wv wo, w1 b1 w2 b2, g1 s1 g2 s2."""
    n, t, d = x.shape
    split = lambda y: y.reshape(n, t, heads, d // heads).transpose(0, 2, 1, 3)
    y = _norm(x, w["g1"], w["s1"])
    y = attention(split(y @ w["wq"]), split(y @ w["wk"]), split(y @ w["wv"]), causal).transpose(0, 2, 1, 3).reshape(n, t, d)
    x = x + y @ w["wo"]
    return x + np.maximum(_norm(x, w["g2"], w["s2"]) @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]


def decoder_layer(x: np.ndarray, memory: np.ndarray, w: dict[str, np.ndarray], heads: int) -> np.ndarray:
    """Pre-norm causal self-attention, attention to the encoder's output, feed-forward. As ``encoder_layer``, and cq ck cv co, g3 s3 for the second."""
    d = x.shape[-1]
    split = lambda y: y.reshape(*y.shape[:2], heads, d // heads).transpose(0, 2, 1, 3)
    joined = lambda y: y.transpose(0, 2, 1, 3).reshape(x.shape)
    y = _norm(x, w["g1"], w["s1"])
    x = x + joined(attention(split(y @ w["wq"]), split(y @ w["wk"]), split(y @ w["wv"]), True)) @ w["wo"]
    y = _norm(x, w["g3"], w["s3"])
    x = x + joined(attention(split(y @ w["cq"]), split(memory @ w["ck"]), split(memory @ w["cv"]))) @ w["co"]
    return x + np.maximum(_norm(x, w["g2"], w["s2"]) @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]


def advance_clock(x: np.ndarray, minutes: int = 15) -> np.ndarray:
    """The eight clock features (weekday, month, hour, minute; sine and cosine) a step later; see ``calendar.next_cycle``."""
    back = lambda i, p: np.rint(np.mod(np.arctan2(x[:, i], x[:, i + 1]) / (2 * np.pi), 1) * p).astype(int) % p
    minute = back(6, 59) + minutes
    hour = back(4, 23) + minute // 60
    angles = ((back(0, 7) + hour // 24) % 7 / 7, hour % 24 / 23, minute % 60 / 59)
    day, clock, rest = (np.column_stack([np.sin(2 * np.pi * v), np.cos(2 * np.pi * v)]) for v in angles)
    return np.hstack([day, x[:, 2:4], clock, rest])


def embedded(x: np.ndarray, weights: dict) -> np.ndarray:
    """Features with each categorical one replaced by its code's vector (an unknown code counts as 0), times the input weights.

    ``weights["categories"]``: place of a feature and its table (codes x width).
    """
    places = [p for p, _ in weights.get("categories", ())]
    parts = [np.delete(x, places, axis=-1)]
    for p, table in weights.get("categories", ()):
        code = x[..., p].astype(int)
        parts.append(table[np.where((code >= 0) & (code < len(table)), code, 0)])
    return np.concatenate(parts, axis=-1) @ weights["embed"]


def forward(x: np.ndarray, weights: dict, heads: int) -> np.ndarray:
    """One forecast for each window: encoder layers, then decoder layers over the last step if there are any, a mean, and a head."""
    start = embedded(x, weights)
    h = start
    for layer in weights["layers"]:
        h = encoder_layer(h, layer, heads)
    if weights.get("decoder"):
        memory, h = h, start[:, -1:]
        for layer in weights["decoder"]:
            h = decoder_layer(h, memory, layer, heads)
    return h.mean(1) @ weights["head"]


def forecast_windows(windows: DataFrame, weights: dict, heads: int = 4, steps: int = 1) -> DataFrame:
    """(site, start, forecast): forecasts over windows (site, start, x), step by step; each step's flow is the next one's last input.

    ``weights``: as in ``forward``, and the places of the flow and of the first of the eight clock features (``clock``; without it
    they stay as they are).
    """
    ship(windows.sparkSession)

    def run(frames):
        for f in frames:
            x = np.array([np.stack(r) for r in f["x"]]) if len(f) else np.zeros((0, 1, 1))
            out = []
            for _ in range(steps if len(f) else 0):
                y = forward(x, weights, heads)
                out.append(y)
                after = x[:, -1:, :].copy()
                after[:, 0, weights.get("flow", -1)] = y
                if "clock" in weights:
                    c = weights["clock"]
                    after[:, 0, c : c + 8] = advance_clock(after[:, 0, c : c + 8])
                x = np.concatenate([x[:, 1:], after], axis=1)
            yield pd.DataFrame({"site": f["site"], "start": f["start"], "forecast": list(np.stack(out, 1)) if out else []})

    return windows.select(F.col(windows.columns[0]).cast("string").alias("site"), F.col("start").cast("long").alias("start"), "x").mapInPandas(run, "site string, start long, forecast array<double>")


def save_weights(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """Named arrays, one row each."""
    rows = [(k, str(v.dtype), list(v.shape), bytearray(np.ascontiguousarray(v).tobytes())) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, kind string, shape array<int>, content binary").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(bytes(r["content"]), r["kind"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}

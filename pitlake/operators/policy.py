"""A small actor-critic: a position in -1..1 and a value from a state, trained on rewards of past decisions with Adam."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a net is fitted on at most, taken by the hash of their id; everything is scored.
FIT_ROWS = 20_000


@dataclass
class Net:
    """One hidden layer with two heads: the mean of the position before it is squashed, and the value."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fresh(cls, x: np.ndarray, hidden: int, rng: np.random.Generator) -> Net:
        d = x.shape[1]
        w = {"w1": rng.normal(0, 1 / np.sqrt(d), (d, hidden)), "b1": np.zeros(hidden), "wa": rng.normal(0, 0.01, hidden), "ba": np.zeros(1), "wv": np.zeros(hidden), "bv": np.zeros(1)}
        sd = x.std(axis=0)
        return cls(w, x.mean(axis=0), np.where(sd > 1e-12, sd, 1.0))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w, z = self.weights, (x - self.mean) / self.scale
        h = np.tanh(z @ w["w1"] + w["b1"])
        return z, h, h @ w["wa"] + w["ba"], h @ w["wv"] + w["bv"]

    def position(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.forward(x)[2])


def gradients(net: Net, x: np.ndarray, action: np.ndarray, reward: np.ndarray, noise: float) -> dict[str, np.ndarray]:
    """Of the mean loss: -advantage x log-probability of the action drawn, and half the squared error of the value."""
    w = net.weights
    z, h, a, v = net.forward(x)
    n, gain = len(x), reward - v
    da = -(gain - gain.mean()) / (gain.std() + 1e-8) * (action - a) / noise**2 / n
    dv = -gain / n
    dh = (np.outer(da, w["wa"]) + np.outer(dv, w["wv"])) * (1 - h * h)
    return {"w1": z.T @ dh, "b1": dh.sum(axis=0), "wa": h.T @ da, "ba": np.array([da.sum()]), "wv": h.T @ dv, "bv": np.array([dv.sum()])}


def train(x: np.ndarray, outcome: np.ndarray, steps: int = 400, batch: int = 512, hidden: int = 16, noise: float = 0.5, rate: float = 0.01, cost: float = 0.0, seed: int = 0, net: Net | None = None) -> Net:
    """A net, new or going on from an earlier one. The reward of a position is position x outcome less its cost, in deviations of the outcomes."""
    rng = np.random.default_rng(seed)
    net = net or Net.fresh(x, hidden, rng)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    s = {k: np.zeros_like(v) for k, v in net.weights.items()}
    unit = outcome.std() or 1.0
    for t in range(1, steps + 1):
        i = rng.integers(0, len(x), min(batch, len(x)))
        action = net.forward(x[i])[2] + noise * rng.normal(size=len(i))
        position = np.tanh(action)
        g = gradients(net, x[i], action, (position * outcome[i] - cost * np.abs(position)) / unit, noise)
        for k in net.weights:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            net.weights[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return net


def fitted(df: DataFrame, features: list[str], outcome: str, row_id: str, **options: object) -> Net | None:
    """A net fitted on at most FIT_ROWS rows of df without nulls, those with the smallest hashes of their id; None if there are none."""
    rows = df.select(*[F.col(f).cast("double") for f in features], F.col(outcome).cast("double").alias("_o"), F.col(row_id).alias("_i")).dropna().orderBy(F.xxhash64("_i"), "_i").limit(FIT_ROWS).toPandas()
    return train(rows[features].to_numpy(), rows["_o"].to_numpy(), **options) if len(rows) else None


def positions(df: DataFrame, net: Net, features: list[str], out: str = "position") -> DataFrame:
    """df with the net's position for every row; null where a feature is null."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
        p = pd.Series(net.position(x))
        return p.where(~np.isnan(x).any(axis=1), None)

    return df.withColumn(out, score(*[F.col(f).cast("double") for f in features]))

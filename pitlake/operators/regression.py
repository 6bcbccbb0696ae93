"""Least squares of many groups at once: sums are made in one aggregation, the small systems are solved a batch of groups at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve(n: np.ndarray, cross: np.ndarray) -> pd.DataFrame:
    """Of g groups: n rows each, and cross (g, k + 2, k + 2), the sums of products of (1, factors, target). A system without one solution has the least one."""
    k = cross.shape[1] - 1
    xx, xy, yy, y = cross[:, :k, :k], cross[:, :k, k], cross[:, k, k], cross[:, 0, k]
    inverse = np.linalg.pinv(xx, rcond=1e-13, hermitian=True)
    w = np.einsum("gij,gj->gi", inverse, xy)
    rss = np.maximum(yy - np.einsum("gi,gi->g", w, xy), 0.0)
    tss = np.maximum(yy - y * y / np.maximum(n, 1), 0.0)
    with np.errstate(all="ignore"):
        error = np.sqrt(np.maximum((rss / np.maximum(n - k, 1))[:, None] * np.einsum("gii->gi", inverse), 0.0))
        t = np.where(error > 0, w / error, 0.0)
        r2 = np.where(tss > 0, 1 - rss / tss, 0.0)
    return pd.DataFrame({"weights": list(w), "t": list(t), "r2": r2, "rss": rss})


def regressions(df: DataFrame, keys: Sequence[str], factors: Sequence[str], target: str) -> DataFrame:
    """(keys, n, weights, t, r2, rss) of each group: the intercept first, then each factor's weight, with their t statistics.

    Rows with a null or NaN factor or target don't count; a group without any has no row. A factor that follows from the others shares its
    weight with them. Only sums leave a group, so its size doesn't matter.
    """
    names = [*factors, target]
    x = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, c in enumerate(names)]).dropna(subset=[f"_x{i}" for i in range(len(names))])
    columns = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(len(names))]]
    size = len(columns)
    sums = [F.sum(columns[i] * columns[j]) for i in range(size) for j in range(i, size)]
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("_s"))

    @F.pandas_udf("weights array<double>, t array<double>, r2 double, rss double")
    def solved(n: pd.Series, s: pd.Series) -> pd.DataFrame:
        cross = np.zeros((len(n), size, size))
        i, j = np.triu_indices(size)
        if len(n):
            cross[:, i, j] = cross[:, j, i] = np.stack(s.to_numpy())
        return solve(n.to_numpy(float), cross)

    return g.withColumn("_r", solved("n", "_s")).select(*keys, "n", "_r.*")

"""The closest pairs of items within groups, by blocks.

A group's items are dealt into blocks of bounded size by a hash; each pair of blocks is a task of its own, which works out all distances between their items
by matrix products and leaves the k closest. So the items of a group meet in blocks whose number is the square of theirs over BLOCK, but no table of all
pairs is ever made, and what is merged at last is k rows from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items of a block: two of them, as series, are what a task holds.
BLOCK = 1024


def _nearest(k: int, least: int):
    def settle(x: pd.DataFrame) -> pd.DataFrame | None:
        """All pairs of the two blocks in x; each item has one row with the places and values of its series."""
        width = max((p[-1] for p in x["places"] if len(p)), default=-1) + 1
        values, there = np.zeros((len(x), width)), np.zeros((len(x), width))
        for i, (places, series) in enumerate(zip(x["places"], x["series"], strict=True)):
            values[i, places], there[i, places] = series, 1.0
        left, right = (np.flatnonzero(x["block"].to_numpy() == b) for b in (x["one"].iloc[0], x["two"].iloc[0]))
        v, m = values[left], there[left]
        u, w = values[right], there[right]
        both = m @ w.T
        # centred on the pair's shared periods, sums of squares lose nothing that matters: series are of size one
        ssd = np.maximum((v * v) @ w.T - 2 * v @ u.T + m @ (u * u).T, 0.0)
        names = x["item"].to_numpy()
        ok = (both >= least) & (names[left][:, None] < names[right][None, :] if x["one"].iloc[0] == x["two"].iloc[0] else names[left][:, None] != names[right][None, :])
        at = np.flatnonzero(ok)
        if not len(at):
            return None
        if len(at) > 4 * k:  # all that may be among the k closest, ties and rounding included
            cut = np.partition(ssd.ravel()[at], k - 1)[k - 1]
            at = at[ssd.ravel()[at] <= cut * (1 + 1e-9) + 1e-9]
        i, j = left[at // len(right)], right[at % len(right)]
        low, high = np.where(names[i] < names[j], i, j), np.where(names[i] < names[j], j, i)
        shared = there[low] * there[high]
        gap = (values[low] - values[high]) * shared
        n, exact = shared.sum(axis=1), (gap * gap).sum(axis=1)
        sd = np.sqrt(np.maximum((exact - gap.sum(axis=1) ** 2 / n) / np.maximum(n - 1, 1), 0.0))
        out = pd.DataFrame({"grp": x["grp"].iloc[0], "a": names[low], "b": names[high], "ssd": exact, "n": n.astype(np.int64), "sd": sd})
        return out.sort_values(["ssd", "a", "b"], kind="stable").head(k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            whole = pd.concat([*held, frame], ignore_index=True) if held else frame
            key = whole[["grp", "one", "two"]]
            cuts = [0, *(np.flatnonzero((key.to_numpy()[1:] != key.to_numpy()[:-1]).any(axis=1)) + 1).tolist(), len(whole)]
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                out = settle(whole.iloc[a:b])
                if out is not None:
                    yield out
            held = [whole.iloc[cuts[-2] :]] if len(whole) else []
        if held:
            out = settle(held[0])
            if out is not None:
                yield out

    return run


def closest_pairs(df: DataFrame, group: str, item: str, at: str, value: str, k: int, least: int, block: int = BLOCK) -> DataFrame:
    """(group, a, b, ssd, n, sd): the k pairs a < b of each group's items with the least sum of squared gaps over the periods that both have, at least ``least``.

    n counts those periods, sd is the gap's sample deviation. Equal sums are told apart by a, then b. Items with fewer periods, and rows with a null group,
    item, period or value, have none; an item has one value for each period, and an empty table no pairs. Items must be of one kind that sorts.
    """
    kinds = dict(df.dtypes)
    x = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(at).alias("at"), F.col(value).cast("double").alias("v")).dropna()
    periods = x.select("at").distinct().withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("at")) - 1)  # one row for each period
    x = x.join(periods, "at").groupBy("grp", "item").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("s")).where(F.size("s") >= least)
    sizes = x.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnRenamed("grp", "_g")
    x = x.join(sizes, F.col("grp") == F.col("_g")).select("grp", "item", "blocks", F.col("s.place").alias("places"), F.col("s.v").alias("series"), F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int").alias("block"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("grp", "item", "places", "series", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    out = x.repartition(4 * cores, "grp", "one", "two").sortWithinPartitions("grp", "one", "two").mapInPandas(_nearest(k, least), f"grp {kinds[group]}, a {kinds[item]}, b {kinds[item]}, ssd double, n bigint, sd double")
    out = out.withColumn("_k", F.row_number().over(W.partitionBy("grp").orderBy("ssd", "a", "b"))).where(F.col("_k") <= k)
    return out.select(F.col("grp").alias(group), "a", "b", "ssd", "n", "sd")

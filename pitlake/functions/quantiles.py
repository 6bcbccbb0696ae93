"""Exact medians and quantiles of groups of any size, by counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets per power of two of a value's magnitude.
FINENESS = 512


def bucket(x: Column) -> Column:
    """An integer that never falls as x rises; neighbouring values share it."""
    size = F.floor(F.log2(F.abs(x)) * FINENESS).cast("bigint") + (1 << 22)
    far = F.lit(1 << 40)
    magnitude = F.when(F.abs(x) == float("inf"), far).otherwise(size)
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, magnitude).otherwise(-magnitude)


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], at: Sequence[float] = (0.5,)) -> DataFrame:
    """(keys, name_n, name) for each of the values by name: its number and exact quantile in each group; with several places ``at``, name_0, name_1 and so on.

    Between two ranks the quantile is interpolated, the median being the mean of the middle two. Nulls and NaN don't count; a group without any value at all is
    left out, one without a value of this name has a null there. No keys: one row for the whole table, none if it is empty. Null keys are a group.

    Two passes for all values together: counts by bucket (combined before the shuffle) find the buckets that hold the ranks, then only their values are
    compared. So no task ever holds a group's values, and a group with a third of all rows costs no more than its buckets.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    entries = F.array(*[F.struct(F.lit(i).alias("w"), v.cast("double").alias("x")) for i, v in enumerate(values.values())])
    x = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], F.inline(entries).alias("_w", "_x")).where("_x is not null and not isnan(_x)").withColumn("_b", bucket(F.col("_x")))
    counts = x.groupBy(*ks, "_w", "_b").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*ks, "_w")
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy("_b"))).withColumn("_n", F.sum("_c").over(w))
    rank = lambda q: F.lit(q) * (F.col("_n") - 1)
    ends = [(F.floor(rank(q)), F.ceil(rank(q))) for q in at]
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    target = ranked.where(reduce(lambda a, b: a | b, [holds(r) for e in ends for r in e]))
    target = target.select(*[F.col(k).alias(f"_t{k}") for k in ks], F.col("_w").alias("_tw"), F.col("_b").alias("_tb"), (F.col("_upto") - F.col("_c")).alias("_base"), "_n")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in ks], (F.col("_w") == F.col("_tw")) & (F.col("_b") == F.col("_tb")))
    near = x.join(target, on).groupBy(*ks, "_w", "_b", "_base", "_n", "_x").agg(F.count("*").alias("_c"))
    near = near.withColumn("_upto", F.col("_base") + F.sum("_c").over(W.partitionBy(*ks, "_w", "_b").orderBy("_x")))
    value = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_x")))
    between = lambda q, lo, hi: (value(lo) + value(hi)) / 2 if q == 0.5 else value(lo) + F.max(rank(q) - lo) * F.when(value(hi) > value(lo), value(hi) - value(lo)).otherwise(0.0)
    found = near.groupBy(*ks, "_w").agg(F.max("_n").alias("_n"), *[between(q, lo, hi).alias(f"_q{i}") for i, (q, (lo, hi)) in enumerate(zip(at, ends, strict=True))])
    wide = []
    for i, name in enumerate(values):
        own = lambda c, i=i: F.max(F.when(F.col("_w") == i, F.col(c)))
        wide += [own("_n").alias(f"{name}_n"), *[own(f"_q{j}").alias(name if len(at) == 1 else f"{name}_{j}") for j in range(len(at))]]
    out = found.groupBy(*ks).agg(*wide)
    if not ks:
        out = out.where(" or ".join(f"{name}_n is not null" for name in values))
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], *out.columns[len(ks) :])


def exact_medians(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, n, out): the number and exact median of each key's values, as in exact_quantiles."""
    return exact_quantiles(df, [key], {"_m": F.col(value)}).select(key, F.col("_m_n").alias("n"), F.col("_m").alias(out))

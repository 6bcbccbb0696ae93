import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from pitlake.functions.quantiles import exact_medians
from pitlake.operators import spikes
from pitlake.operators.spikes import implausible

SCHEMA = "bar_id bigint, ticker string, timestamp timestamp, open double, high double, low double, close double, volume bigint, series string"


def brute(bars):
    out = set()
    frame = pd.DataFrame(bars, columns=[p.split()[0] for p in SCHEMA.split(", ")]).dropna(subset=["ticker", "timestamp", "bar_id"]).drop_duplicates(["ticker", "timestamp", "bar_id"])
    for _, g in frame.sort_values(["ticker", "timestamp", "bar_id"]).groupby("ticker"):
        o, h, lo, c, v = (g[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume"))
        ids = g["bar_id"].to_numpy()
        with np.errstate(all="ignore"):
            out.update(ids[(o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0) | (v < 0) | (h < lo) | (o < lo) | (o > h) | (c < lo) | (c > h)])
            out.update(ids[v > 20 * np.nanmedian(v)] if (~np.isnan(v)).any() else [])
            ok = np.flatnonzero(~np.isnan(c))
            cc = c[ok]
            move = np.abs(cc[1:] / cc[:-1] - 1)
            move = move[~np.isnan(move)]
            if len(move):
                t = 10 * np.median(move)
                for n in (1, 2, 3):
                    for a in range(1, len(cc) - n):
                        d = np.concatenate([cc[a : a + n] / cc[a - 1] - 1, cc[a : a + n] / cc[a + n] - 1])
                        if (d > t).all() or (d < -t).all():
                            out.update(ids[ok[a : a + n]])
                last = np.nan
                for i in range(len(c)):
                    x, y = o[i] / last - 1, o[i] / c[i] - 1
                    if (x > t and y > t) or (x < -t and y < -t):
                        out.add(ids[i])
                    last = last if np.isnan(c[i]) else c[i]
        i = 0
        while i < len(c):
            j = i
            while j + 1 < len(c) and o[j + 1] == o[i] and c[j + 1] == c[i] and v[j + 1] == v[i] and v[i] != 0:
                j += 1
            if j - i >= 5:
                out.update(ids[i : j + 1])
            i = j + 1
    return {int(x) for x in out}


def series(seed, ticker, n, first, dirty=0.05):
    r, out, px = random.Random(seed), [], 100.0
    for i in range(n):
        px *= 1 + r.gauss(0, 0.001)
        o, c, v = px, px * (1 + r.gauss(0, 0.0005)), r.randrange(500, 1500)
        if r.random() < dirty:
            c = r.choice([c * 1.2, c * 0.8, None, c, 0.0, -1.0])
        if r.random() < dirty:
            o = r.choice([o * 1.3, 0.0, o, None])
        if r.random() < dirty:
            v = r.choice([v * 50, -5, None, 0])
        known = [x for x in (o, c) if x is not None] or [px]
        out.append((first + i, ticker, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), o, max(known) * 1.001, min(known) * 0.999, c, v, "x"))
    return out


def stuck(rows, at, n):
    return [(*r[:3], *rows[at][3:8], r[8]) if at <= i < at + n else r for i, r in enumerate(rows)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_against_brute_force(spark, partitions):
    bars = stuck(stuck(series(1, "A", 900, 0), 100, 6), 300, 5) + series(2, "B", 40, 10_000) + series(3, "C", 300, 20_000, 0.6) + series(4, "D", 3, 30_000)
    bars += bars[::7]  # delivered again
    bars += [(1, None, dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, -1.0, 1, "x"), (2, "A", None, 1.0, 1.0, 1.0, -1.0, 1, "x"), (None, "A", dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, -1.0, 1, "x")]
    got = [r.bar_id for r in implausible(spark.createDataFrame(bars, SCHEMA), partitions=partitions).collect()]
    assert set(got) == brute(bars) and len(got) == len(set(got))


def test_the_ellipsoid_decides(spark):
    """The rule is asked of what lies outside alone: with axes ten times as long, runs that the rule would flag stay inside."""
    bars = series(1, "A", 900, 0)
    hard = {r[0] for r in bars if min([x for x in r[3:7] if x is not None], default=1) <= 0 or (r[7] or 0) < 0}
    narrow, wide = ({r.bar_id for r in implausible(spark.createDataFrame(bars, SCHEMA), widen=w).collect()} for w in (1.0, 1000.0))
    assert narrow == brute(bars) and hard <= wide < narrow and len(narrow - wide) > 10


def test_flagging_is_repeated():
    """Axes are those of the points left: shorter than those of all points, and no point left lies outside."""
    r = np.random.default_rng(2)
    d = np.abs(np.concatenate([r.normal(0, 0.001, (2000, 3)), r.normal(0, 0.02, (300, 3))]))
    x = pd.DataFrame({"series": "A", **{f"b{k}": np.floor(np.log2(d[:, k]) * spikes.CELLS).astype(np.int16) for k in range(3)}, "k": 1})
    other = x.assign(series="B", k=3)
    parts = [x.iloc[:700], x.iloc[700:], other.iloc[:1], other.iloc[1:]]
    got = pd.concat(spikes._ellipsoids(1.0)(iter(parts))).set_index("series")
    assert sorted(got.index) == ["A", "B"]
    once = spikes.MAD * np.sqrt(2 * np.log(len(d))) * np.median(d, axis=0)
    axes = got.loc["A"].to_numpy(float)
    assert (axes < 0.97 * once).all()
    size = np.exp2((x[["b0", "b1", "b2"]].to_numpy(float) + 0.5) / spikes.CELLS)
    left = size[((size / axes) ** 2).sum(axis=1) <= 1]
    again = spikes.MAD * np.sqrt(2 * np.log(len(d))) * np.median(left, axis=0)
    assert again == pytest.approx(axes, rel=0.1)


def test_edges(spark):
    one = [(1, "A", dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1, "x")]
    flat = [(i, "F", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 0, "x") for i in range(20)]
    nulls = [(100 + i, "N", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), None, None, None, None, None, "x") for i in range(20)]
    nan = [(200 + i, "Q", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), float("nan"), 1.0, 1.0, float("nan"), 1, "x") for i in range(5)]
    assert implausible(spark.createDataFrame([], SCHEMA)).count() == 0
    assert implausible(spark.createDataFrame(one + flat + nulls + nan, SCHEMA)).count() == 0


def test_usual_move_of_zero(spark):
    px = [5.0] * 10 + [6.0] + [5.0] * 10
    bars = [(i, "Z", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), p, p, p, p, i + 1, "x") for i, p in enumerate(px)]
    assert {r.bar_id for r in implausible(spark.createDataFrame(bars, SCHEMA)).collect()} == brute(bars) == {10}


def test_long_null_stretches_at_partition_ends(spark):
    bars = [(i, "A", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), 10.0, 20.0, 5.0, None if i % 50 else 10.0 + (i // 50) * 0.001 + (5 if i == 500 else 0), i, "x") for i in range(1000)]
    assert {r.bar_id for r in implausible(spark.createDataFrame(bars, SCHEMA), partitions=25).collect()} == brute(bars)


def test_exact_medians(spark):
    r = random.Random(3)
    rows = [(k, x) for k in "abc" for x in [r.choice([r.gauss(0, 1), float(r.randrange(5)), 1e-300, -1e300]) for _ in range(r.choice([1, 2, 999, 1000]))]]
    rows += [("d", None), ("e", float("nan")), ("f", float("inf")), ("f", 1.0), (None, 2.0), ("g", 0.0), ("g", -0.0)]
    got = {x.k: (x.n, x.m) for x in exact_medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", "m").collect()}
    for k in "abc":
        v = [x for q, x in rows if q == k]
        assert got[k] == (len(v), pytest.approx(float(np.median(v))))
    assert "d" not in got and "e" not in got
    assert got["f"] == (2, float("inf")) and got[None] == (1, 2.0) and got["g"] == (2, 0.0)


def test_constants():
    assert spikes.RUN == 3 and spikes.STUCK == 6

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.functions.quantiles import exact_quantiles
from pitlake.operators import folds
from pitlake.operators.folds import fold
from pitlake.operators.pairs import closest_pairs
from pitlake.operators.recipes import Signal, SignalError, Term, compiled, read
from pitlake.operators.resampling import difference, intercept, interval, mean, mean_to_deviation, overlapping, path_cone, slope


def d(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_fold_keeps_state_over_batches(spark):
    rows = [(k, d(n), r) for k, seed in (("a", 1), ("b", 2), (None, 3)) for r0 in [random.Random(seed)] for n in range(200) for r in [r0.gauss(0, 0.03)]]
    df = spark.createDataFrame(rows, "key string, day date, r double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = fold(df, ["key"], ["day"], folds.brake(), "key string, day date, y double, m double, equity double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        eq = peak = before = 1.0
        have = {x.day: x for x in got if x.key == key}
        for _, day, r in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            fall = 1 - eq / peak
            m = 0.5 if fall >= 0.2 else 2 / 3 if fall >= 0.1 else 1.0
            eq *= 1 + m * r - abs(m - before) * 0.001
            peak, before = max(peak, eq), m
            assert have[day].equity == pytest.approx(eq) and have[day].m == m
    assert fold(df.limit(0), ["key"], ["day"], folds.brake(), "key string, day date, y double, m double, equity double").count() == 0


def test_greedy_skips_and_goes_on(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([50, 60, 40, 10, 1])], "key string, item int, size int")
    got = fold(df, ["key"], ["item"], folds.greedy(100), "key string, item int, taken boolean, used bigint").collect()
    assert [x.taken for x in sorted(got, key=lambda x: x.item)] == [True, False, True, True, False]


def test_signals(spark):
    df = spark.createDataFrame([(1, 1.0, "u", "g1"), (1, 2.0, "v", "g1"), (1, None, "u", "g2"), (1, 2.0, None, "g1")], "m int, x double, c string, g string")
    ok = read("+x - c:u within g(g1, g3)", df.schema)
    assert ok == Signal((Term("x", None, 1), Term("c", "u", -1)), "g", ("g1", "g3"))
    assert str(ok) == str(read(" -c : u +x  within g ( g3,g1 )", df.schema)) == "-c:u +x within g(g1, g3)"
    for bad in ("", "x", "+y", "+c", "+x +x", "+x ++", "+x within h(a)", "+x within g()", "+x within g(", "+x -x", "+m +x +c:u +c:v +g:g1"):
        with pytest.raises(SignalError):
            read(bad, df.schema)
    got = [r.score for r in compiled(df, ok, "m").collect()]
    assert sorted(x for x in got if x is not None) == pytest.approx(sorted([1 / 3 - 3.5 / 4, 2.5 / 3 - 1.5 / 4, 2.5 / 3 - 1.5 / 4])) and got.count(None) == 1
    assert compiled(df.limit(0), "+x", "m").count() == 0


def _place(room, *of):
    return int(hashlib.md5("|".join(map(str, of)).encode()).hexdigest()[:8], 16) % room


def _draws(n, draws, block, circular, seed=0):
    size = min(block, n)
    room = n if circular else n - size + 1
    return np.array([[(_place(room, seed, d, i // size) + i % size) % n for i in range(n)] for d in range(draws)])


@pytest.mark.parametrize(("block", "circular"), [(1, True), (3, True), (7, False), (99, False)])
def test_intervals(spark, block, circular):
    assert overlapping(20, 5) == 4 and overlapping(5, 5) == 1 and overlapping(6, 5) == 2 and overlapping(1, 20) == 1
    r = np.random.default_rng(1)
    x, y = r.normal(size=41), r.normal(size=41)
    rows = [("a", n, float(x[n]), float(y[n])) for n in range(41)] + [("b", 0, 1.0, 1.0), ("c", 0, None, 1.0), ("a", 99, None, 0.0), (None, 1, 2.0, 2.0), (None, 2, 2.0, 3.0)]
    df = spark.createDataFrame(rows[::-1], "k string, t int, x double, y double")
    stats = {"mean": mean("x"), "sharpe": mean_to_deviation("x", 12.0), "gap": difference("y", "x"), "beta": slope("y", "x"), "alpha": intercept("y", "x")}
    got = {(q.k, q.statistic): q for q in interval(df, ["k"], ["t"], ["x", "y"], stats, draws=300, block=block, circular=circular).collect()}
    i = _draws(41, 300, block, circular)
    a, b = x[i], y[i]
    beta = np.array([np.cov(p, q)[0, 1] / np.var(p, ddof=1) for p, q in zip(a, b)])
    want = {"mean": a.mean(1), "sharpe": a.mean(1) / a.std(1, ddof=1) * 12**0.5, "gap": (b - a).mean(1), "beta": beta, "alpha": b.mean(1) - beta * a.mean(1)}
    for name, of in want.items():
        q = got["a", name]
        assert q.n == 41 and (q.lo, q.hi) == pytest.approx(tuple(np.percentile(of, [2.5, 97.5])), abs=1e-9), name
    assert got["a", "mean"].estimate == pytest.approx(x.mean()) and got["b", "mean"].lo is None and ("c", "mean") not in got
    assert got[None, "mean"].lo == 2.0 and got[None, "sharpe"].estimate is None and got[None, "beta"].lo is None
    assert interval(df.limit(0), ["k"], ["t"], ["x"], {"mean": mean("x")}).count() == 0


def test_path_cone(spark):
    r = [0.01, -0.02, 0.005, -0.03, 0.02] * 8
    df = spark.createDataFrame([(k, v) for k, v in enumerate(r)] + [(99, None)], "t int, r double")
    got = {q.path: q for q in path_cone(df, ["t"], "r", 33, 250, 5).collect()}
    assert sorted(got) == list(range(250))
    for path in (0, 99, 100, 249):
        g = np.cumprod([1 + r[_place(36, 0, path, i // 5) + i % 5] for i in range(33)])
        top = np.maximum.accumulate(np.append(1.0, g))[1:]
        assert got[path].final == pytest.approx(g[-1]) and got[path].worst == pytest.approx(min(0.0, (g / top - 1).min()))
    assert path_cone(df.limit(0), ["t"], "r", 10, 10, 5).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_closest_pairs(spark, block):
    r = random.Random(7)
    rows = [(g, i, d(t), float(r.randrange(12))) for g in ("g", "h") for i in range(25) for t in range(r.choice([2, 9, 10])) if r.random() < 0.9]
    rows += [("g", 100 + k, d(t), 3.0) for k in range(3) for t in range(9)]  # equal series: ties at nothing
    df = spark.createDataFrame(rows + [(None, 1, d(1), 1.0), ("g", None, d(1), 1.0), ("g", 3, None, 1.0), ("one", 1, d(1), 1.0)], "g string, i bigint, t date, v double")
    want = []
    for g in ("g", "h"):
        s = {}
        for q in rows:
            if q[0] == g:
                s.setdefault(q[1], {})[q[2]] = q[3]
        pairs = []
        for a in s:
            for b in s:
                gap = [s[a][t] - s[b][t] for t in sorted(s[a].keys() & s[b].keys())]
                if a < b and len(gap) >= 6:
                    pairs.append((sum(x * x for x in gap), a, b, len(gap), float(np.std(gap, ddof=1))))
        want += [(g, a, b, ssd, n, pytest.approx(sd)) for ssd, a, b, n, sd in sorted(pairs)[:7]]
    got = [tuple(x) for x in closest_pairs(df, "g", "i", "t", "v", 7, 6, block=block).orderBy("g", "ssd", "a", "b").collect()]
    assert got == want
    assert closest_pairs(df.limit(0), "g", "i", "t", "v", 7, 6).count() == 0


@pytest.mark.parametrize("at", [(0.5,), (0.0, 0.02, 0.98, 1.0), (1 / 3,)])
def test_exact_quantiles(spark, at):
    r = random.Random(3)
    rows = [(k, r.choice([None, float("nan"), r.gauss(0, 1), float(r.randrange(4)), -1e300]), r.gauss(5, 1) if k != "b" else None) for k in ("a", "b", None) for _ in range(500)]
    df = spark.createDataFrame(rows + [("c", None, None)], "k string, x double, y double")
    names = lambda v: [v] if len(at) == 1 else [f"{v}_{j}" for j in range(len(at))]
    groups = {(k,): [q for q in rows if q[0] == k] for k in ("a", "b", None)} | {(): rows}
    for keys in (["k"], []):
        got = {tuple(q[k] for k in keys): q for q in exact_quantiles(df, keys, {"x": F.col("x"), "y": F.col("y")}, at).collect()}
        assert len(got) == (3 if keys else 1)
        for key, q in got.items():
            for place, v in ((1, "x"), (2, "y")):
                have = [z[place] for z in groups[key] if z[place] is not None and z[place] == z[place]]
                assert q[f"{v}_n"] == (len(have) or None)
                assert [q[n] for n in names(v)] == (pytest.approx(list(np.quantile(have, at)), rel=1e-9, abs=1e-9) if have else [None] * len(at))
    assert exact_quantiles(df.limit(0), [], {"x": F.col("x")}).count() == 0


def test_least_variance():
    from pitlake.plans.valuation import least_variance

    assert least_variance([[1.0, 0.0], [0.0, 3.0]]) == pytest.approx([0.75, 0.25])


def test_fits(spark):
    from pitlake.plans.valuation import logistic, ridge

    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 2))
    y = 1.5 * x[:, 0] - 0.5 * x[:, 1] + 2 + r.normal(scale=0.1, size=4000)
    up = (1 / (1 + np.exp(-(x[:, 0] - 2 * x[:, 1] + 0.3))) > r.random(4000)).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, up, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, y double, up double")
    w, mean = ridge(df, ["a", "b"], "y", 0.0)
    assert w == pytest.approx([1.5 * x[:, 0].std(), -0.5 * x[:, 1].std()], abs=0.02) and mean == pytest.approx(y.mean())
    assert logistic(df, ["a", "b"], "up", 1e-6) == pytest.approx([1, -2, 0.3], abs=0.15)
    assert ridge(df.limit(0), ["a"], "y", 1.0) == ([0.0], 0.0) and logistic(df.limit(0), ["a"], "up") == [0.0, 0.0]


def test_sticky_exposure():
    from collections import namedtuple

    Row = namedtuple("Row", "key day r vol")
    step = folds.sticky_exposure(0.15, 1.5, 0.1, 0.0)()
    got = [step(Row("k", 0, 0.01, v))[3] for v in (None, 0.15, 0.145, 0.1, 0.05, 0.0)]
    assert got == pytest.approx([1, 1, 1, 1.5, 1.5, 1.5])


def test_options_in_batches():
    import pandas as pd

    from pitlake.plans.portfolio import call_price
    from pitlake.plans.research import tree_values

    k, v = pd.Series([90.0, 100.0, 110.0]), pd.Series([0.2, 0.3, 0.4])
    put = tree_values(k, v, 100.0, 0.03, 0.5, 400).to_numpy()
    european = call_price(k.to_numpy(), v.to_numpy(), 100.0, 0.03, 0.5) - 100 + k.to_numpy() * np.exp(-0.015)
    assert (put >= european - 0.02).all() and put == pytest.approx(european, abs=0.4)
    assert len(tree_values(k[:0], v[:0], 100.0, 0.03, 0.5, 5)) == 0


def test_policy(spark):
    from pitlake.operators import policy

    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 2))
    gain = 0.02 * np.sign(x[:, 0]) + r.normal(scale=0.02, size=3000)
    net = policy.train(x, gain, seed=1)
    assert np.mean(net.position(x) * np.sign(x[:, 0])) > 0.6
    # gradients against differences of the loss
    net = policy.Net.fresh(x, 3, r)
    net.weights["wv"] = r.normal(size=3)
    i, noise = slice(0, 50), 0.5
    act, rew = r.normal(size=50), r.normal(size=50)

    def loss():
        _, _, a, v = net.forward(x[i])
        return np.mean(adv * (act - a) ** 2 / (2 * noise**2)) + np.mean((rew - v) ** 2) / 2

    g = policy.gradients(net, x[i], act, rew, noise)
    gap = rew - net.forward(x[i])[3]
    adv = (gap - gap.mean()) / (gap.std() + 1e-8)
    for k in ("w1", "wa", "wv", "bv"):
        old = net.weights[k].copy()
        at = (0,) * old.ndim
        net.weights[k][at] = old[at] + 1e-6
        up = loss()
        net.weights[k][at] = old[at] - 1e-6
        assert g[k][at] == pytest.approx((up - loss()) / 2e-6, abs=1e-5)
        net.weights[k] = old
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.1), (2, None, 2.0, 0.1)], "i int, a double, b double, o double")
    net = policy.fitted(df, ["a", "b"], "o", "i", steps=5)
    got = {q.i: q.position for q in policy.positions(df, net, ["a", "b"]).collect()}
    assert got[2] is None and -1 <= got[1] <= 1 and policy.fitted(df.limit(0), ["a"], "o", "i") is None

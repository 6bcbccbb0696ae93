import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.functions import finance
from pitlake.operators.flows import fourth_quarters, from_year_to_date
from pitlake.operators.regression import regressions

FACTS = "e string, start date, finish date, value double, flow string"


def d(text):
    return dt.date.fromisoformat(text)


def facts(spark, rows):
    return spark.createDataFrame([(e, d(a) if a else None, d(b) if b else None, v, "clash") for e, a, b, v in rows], FACTS)


def test_fourth_quarters(spark):
    q = [("2020-01-01", "2020-03-31", 1.0), ("2020-04-01", "2020-06-30", 2.0), ("2020-07-01", "2020-09-30", 3.0)]
    rows = [("a", *x) for x in q] + [("a", "2020-01-01", "2020-12-31", 10.0), ("a", "2020-01-01", "2020-03-31", 1.0)]  # repeated
    rows += [("full", *x) for x in q] + [("full", "2020-10-01", "2020-12-31", 4.0), ("full", "2020-01-01", "2020-12-31", 10.0)]
    rows += [("two", *x) for x in q[:2]] + [("two", "2020-01-01", "2020-12-31", 10.0)] + [("none", *x) for x in q]
    rows += [("odd", "2019-07-01", "2020-06-30", 20.0), ("odd", "2019-07-01", "2019-09-28", 4.0), ("odd", "2019-09-29", "2019-12-28", 5.0), ("odd", "2019-12-29", "2020-03-28", 6.0), ("odd", "2020-01-01", "2020-06-30", 99.0)]
    rows += [(None, *q[0]), ("a", None, "2020-03-31", 1.0), ("a", "2021-01-01", "2021-12-31", None)]
    got = sorted(map(tuple, fourth_quarters(facts(spark, rows), "e").collect()))
    assert got == [("a", d("2020-10-01"), d("2020-12-31"), 4.0), ("odd", d("2020-03-29"), d("2020-06-30"), 5.0)]
    assert fourth_quarters(facts(spark, []), "e").count() == 0


def test_from_year_to_date(spark):
    rows = [("a", "2020-01-01", f, v) for f, v in (("2020-03-31", 10.0), ("2020-06-30", 30.0), ("2020-09-30", 60.0), ("2020-12-31", 100.0))]
    rows += [("a", "2021-01-01", "2021-03-31", 15.0), ("a", "2021-01-01", "2021-09-30", 70.0), ("b", "2021-01-01", "2021-03-31", 5.0), (None, "2021-01-01", "2021-03-31", 5.0)]
    got = {(r.e, str(r.finish)): (r.flow, r.trailing) for r in from_year_to_date(facts(spark, rows), "e").collect()}
    assert got == {
        ("a", "2020-03-31"): (10.0, None), ("a", "2020-06-30"): (20.0, None), ("a", "2020-09-30"): (30.0, None), ("a", "2020-12-31"): (40.0, None),
        ("a", "2021-03-31"): (15.0, 105.0), ("a", "2021-09-30"): (None, 110.0), ("b", "2021-03-31"): (5.0, None),
    }
    assert from_year_to_date(facts(spark, []), "e").count() == 0


def test_regressions(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in ("g", "h"):
        x = r.normal(size=(60, 2)) + 3
        y = 0.5 + x @ [1.5, -2.0] + r.normal(scale=0.3, size=60)
        rows += [(g, float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)]
    extra = [("g", None, 1.0, 1.0), ("g", float("nan"), 1.0, 1.0), ("none", 1.0, None, 1.0), ("one", 1.0, 2.0, 3.0), ("flat", 1.0, 1.0, 1.0), ("flat", 1.0, 2.0, 1.0), ("flat", 1.0, 3.0, 1.0)]
    got = {q.k: q for q in regressions(spark.createDataFrame(rows + extra, "k string, a double, b double, y double"), ["k"], ["a", "b"], "y").collect()}
    for g in ("g", "h"):
        m = np.array([q[1:] for q in rows if q[0] == g])
        x = np.column_stack([np.ones(len(m)), m[:, :2]])
        w, (rss,), *_ = np.linalg.lstsq(x, m[:, 2], rcond=None)
        se = np.sqrt(np.diag(rss / (len(m) - 3) * np.linalg.inv(x.T @ x)))
        assert got[g].n == 60 and got[g].weights == pytest.approx(list(w)) and got[g].t == pytest.approx(list(w / se), rel=1e-6)
        assert got[g].r2 == pytest.approx(1 - rss / ((m[:, 2] - m[:, 2].mean()) ** 2).sum())
    assert "none" not in got and got["one"].n == 1 and got["flat"].r2 == 0.0
    assert regressions(spark.createDataFrame([], "k string, a double, b double, y double"), ["k"], ["a"], "y").count() == 0


def test_figures(spark):
    x = spark.range(1).select(F.lit(100.0).alias("revenue"), F.lit(60.0).alias("cogs"), F.lit(0.0).alias("total_equity"), F.lit(5.0).alias("total_debt"), F.lit(20.0).alias("price"), F.lit(2.0).alias("eps"), F.lit(5.0).alias("eps_growth_pct"))
    r = x.select(finance.ratio("gross_margin").alias("g"), finance.ratio("debt_to_equity").alias("d"), finance.ratio("price_to_earnings").alias("pe"), finance.ratio("peg_ratio").alias("peg"),
        finance.kelly(F.lit(0.6), F.lit(1.0)).alias("k"), finance.kelly(F.lit(1.0), F.lit(1.0)).alias("k1"), finance.kelly(F.lit(0.2), F.lit(1.0)).alias("k0"),
        finance.capital_cost(F.lit(60.0), F.lit(40.0), F.lit(0.1), F.lit(0.05), F.lit(0.2)).alias("wacc"), finance.capital_cost(F.lit(0.0), F.lit(0.0), F.lit(0.1), F.lit(0.05), F.lit(0.2)).alias("none"),
        finance.equity_cost(F.lit(0.03), F.lit(1.2), F.lit(0.05)).alias("capm"), finance.stressed(F.lit(100.0), {"m": F.lit(1.5), "x": F.lit(None).cast("double")}, {"m": -0.2, "x": 0.5, "y": 1.0}).alias("stress")).first()
    assert (r.g, r.d, r.pe, r.peg) == (0.4, None, 10.0, 2.0) and r.k == pytest.approx(0.1) and r.k1 is None and r.k0 == 0.0
    assert r.wacc == pytest.approx(0.076) and r.none is None and r.capm == pytest.approx(0.09) and r.stress == pytest.approx(70.0)
    s = spark.createDataFrame([(0.1,), (-0.05,), (0.02,)], "r double").agg(finance.sharpe(F.col("r"), 12.0).alias("s"), finance.sortino(F.col("r"), 12.0).alias("o")).first()
    v = np.array([0.1, -0.05, 0.02])
    assert s.s == pytest.approx(v.mean() / v.std(ddof=1) * 12**0.5) and s.o == pytest.approx(v.mean() / 0.05 * 12**0.5)
    flat = spark.createDataFrame([(0.1,), (0.1,)], "r double").agg(finance.sharpe(F.col("r"), 12.0).alias("s"), finance.sortino(F.col("r"), 12.0).alias("o")).first()
    assert (flat.s, flat.o) == (0.0, 0.0)

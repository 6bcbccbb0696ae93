import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from pitlake.operators import units
from pitlake.operators.units import claim_units, history_units, pelt, text_unit

NOTES = {
    "USD": 1, " $ ": 1, "usd (units)": 1, "IN WHOLE DOLLARS": 1, "US dollars": 1, "USD thousands": 1e3, "(000s)": 1e3, "USD '000": 1e3, "k$": 1e3, "Tsd. USD": 1e3, "x1,000 USD": 1e3,
    "amounts in thousands of dollars": 1e3, "USD mn": 1e6, "$ MM": 1e6, "US$ m": 1e6, "Mio. USD": 1e6, "en millions de dollars": 1e6, "millones de USD": 1e6, "in millions": 1e6, "USD bn": 1e9, "Mrd. USD": 1e9, "US$ billions": 1e9,
    "milliards de dollars": 1e9,
}
QUARTERS = "fact_id bigint, cik bigint, period_end date, value double, source string, unit_note string, day int"


def test_notes(spark):
    rows = [(i, 1, dt.date(2020, 1, 1), 2.5, "s", n, 0) for i, n in enumerate(NOTES)]
    got = {r.fact_id: r.common_value for r in history_units(spark.createDataFrame(rows, QUARTERS), "cik", "source", "fact_id", "period_end", "value", "unit_note").collect()}
    for i, (note, k) in enumerate(NOTES.items()):
        assert got[i] == round(2.5 * k + 1e-9) or k == 1 and got[i] == 3, note


def test_histories_without_notes(spark):
    r, rows, want = random.Random(5), [], {}
    for cik in range(12):
        level = 10 ** r.uniform(7.5, 10)
        unit = 1
        for q in range(40):
            level *= 1 + r.gauss(0.02, 0.1)
            true = round(level / 10_000) * 10_000
            end = dt.date(2010, 1, 1) + dt.timedelta(days=91 * q)
            for source in ("a", "b") if cik else ("a",) * 20:  # one history is hot
                if r.random() < 0.3:
                    unit = r.choice([1, 1_000, 1_000_000, 1_000_000_000])
                stated = source == "a" and r.random() < 0.5
                k = 1 if stated or source == "a" else unit
                i = len(rows)
                rows.append((i, cik, end, true / k, source, "USD" if stated else None, 0))
                want[i] = true
    rows += rows[:30]
    got = history_units(spark.createDataFrame(rows, QUARTERS), "cik", "source", "fact_id", "period_end", "value", "unit_note").collect()
    assert len(got) == len(want)
    assert {x.fact_id: x.common_value for x in got} == want
    assert {x.common_unit for x in got} == {"USD"}


def test_history_edges(spark):
    d = dt.date(2020, 1, 1)
    rows = [(1, 1, d, None, "s", None, 0), (2, 1, d, float("nan"), "s", "USD", 0), (3, 1, d, 0.0, "s", None, 0), (4, None, d, 5e7, None, None, 0), (5, 1, None, 6e7, "s", "USD", 0), (6, 1, d, -6.1e4, "s", None, 0)]
    hist = lambda x: history_units(spark.createDataFrame(x, QUARTERS), "cik", "source", "fact_id", "period_end", "value", "unit_note")
    assert {r.fact_id: r.common_value for r in hist(rows).collect()} == {3: 0, 4: 50_000_000, 5: 60_000_000, 6: -61_000_000}
    assert hist([]).count() == 0
    assert hist([(1, 1, d, 5.0, "s", None, 0)]).count() == 1  # nothing stated anywhere


def _history(spark, rows):
    return {x.fact_id: x.common_value for x in history_units(spark.createDataFrame(rows, QUARTERS), "cik", "source", "fact_id", "period_end", "value", "unit_note").collect()}


def _dates(n):
    return [dt.date(2010, 1, 1) + dt.timedelta(days=91 * q) for q in range(n)]


def test_segments_decide(spark, monkeypatch):
    """One odd quarter, 1.6 decades off, is by itself nearer to millions, but its segment is in thousands; and without a search rows change."""
    d = _dates(24)
    rows = [(i, 1, d[i], 2e9, "a", "USD", 0) for i in range(24)]
    rows += [(100 + i, 1, d[i], 2e9 / (1e3 if i < 12 else 1e6) / (10**1.6 if i == 6 else 1), "b", None, 0) for i in range(24)]
    got = _history(spark, rows)
    assert {got[100 + i] for i in range(24) if i != 6} == {2_000_000_000}
    assert got[106] == round(2e9 / 10**1.6)
    # the rows of a history as the search sees them, and a search that finds no change
    x = pd.DataFrame({"entity": "1", "source": "b", "day": range(24), "lev": 0, "n": 1.0, "s1": [-3.0] * 12 + [-6.0] * 12})
    x = x.assign(s2=x["s1"] ** 2)
    assert pd.concat(units._segments(iter([x])))["shift"].tolist() == [3] * 12 + [6] * 12
    monkeypatch.setattr(units, "pelt", lambda n, s1, s2, penalty: [(0, len(n))])
    assert set(pd.concat(units._segments(iter([x])))["shift"]) != {3, 6}


def test_a_busy_year_is_searched_like_any_other(spark):
    """Hundreds of facts of one day are one point for each level, in whatever units."""
    d = _dates(12)
    rows = [(i, 1, d[i], 3e9, "a", "USD", 0) for i in range(12)]
    rows += [(1000 + 12 * k + i, 1, d[i], (3e9 + 1e7 * (k % 7)) / (1e3 if k % 2 else 1e9), "b", None, 0) for k in range(300) for i in range(12)]
    got = _history(spark, rows)
    assert all(got[1000 + 12 * k + i] == 3_000_000_000 + 10_000_000 * (k % 7) for k in range(300) for i in range(12))


def test_values_beyond_a_bigint(spark):
    d = dt.date(2020, 1, 1)
    assert _history(spark, [(1, 1, d, 1e24, "s", "USD", 0), (2, 1, d, 1e300, "s", None, 0), (3, 1, d, 5e9, "s", "USD", 0), (4, 1, d, float("inf"), "s", "USD", 0)]) == {1: None, 2: None, 3: 5_000_000_000}


@pytest.mark.parametrize("seed", range(5))
def test_pelt_is_exact(seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([np.full(k, 3.0 * m) + r.normal(0, 0.1, k) for k, m in zip(r.integers(1, 9, 6), r.integers(0, 4, 6), strict=True)])
    w = r.integers(1, 5, len(x)).astype(float)
    p1, p2 = w * x, w * (x * x + 0.01)
    n, w0, s1, s2 = len(x), *(np.concatenate([[0], np.cumsum(y)]) for y in (w, p1, p2))
    cost = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (w0[b] - w0[a])
    best = [-1.0] + [np.inf] * n
    for t in range(1, n + 1):
        best[t] = min(best[a] + cost(a, t) + 1.0 for a in range(t))
    cuts = pelt(w, p1, p2, 1.0)
    assert cuts[0][0] == 0 and cuts[-1][1] == n and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert sum(cost(a, b) + 1.0 for a, b in cuts) - 1.0 == pytest.approx(best[n])


TEXTS = [
    ("revenue of $392.2 million in Q4 2020. Consensus stood at USD 332,481,174.2053.", 392.2, "USD", "USD million"),
    ("came to USD 23,186,900k.", 23186900.0, "USD", "USD thousand"), ("US$2938m", 2938.0, "USD", "USD million"), ("showed $1712100000 outright", 1712100000.0, "USD", "USD"),
    ("0.0238 billion dollars.", 0.0238, "USD", "USD billion"), ("ressort à 583 800 milliers de dollars sur Q1 2022.", 583800.0, "USD", "USD thousand"), ("atteint 24 479,7 M$.", 24479.7, "USD", "USD million"),
    ("lag bei 2.397.300.000 US-Dollar.", 2397300000.0, "USD", "USD"), ("250 Millionen US-Dollar", 250.0, "USD", "USD million"), ("waren es 3,5 Mrd. USD.", 3.5, "USD", "USD billion"),
    ("free cash flow $-33,200 thousand", -33200.0, "USD", "USD thousand"), ("at 31200000 (FY20).", 31200000.0, "USD", None), ("In Q4 2020 392.2 million dollars", 392.2, "USD", "USD million"),
    ("margin 22.75 per cent in FY24.", 22.75, "basis point", "percent"), ("20.55%", 20.55, "basis point", "percent"), ("19bp", 19.0, "basis point", "basis point"), ("1.266 Basispunkte.", 1266.0, "basis point", "basis point"),
    ("came to a ratio of 0.2968.", 0.2968, "basis point", "fraction"), ("0.0053 as a fraction of sales", 0.0053, "basis point", "fraction"), ("einen Anteil von 0,1852.", 0.1852, "basis point", "fraction"), ("margin at 6.7 (Q1 2018).", 6.7, "basis point", None),
    ("earnings $(0.44) per share", -0.44, "US cent per share", "USD per share"), ("-244¢ a share", -244.0, "US cent per share", "US cent per share"), ("469 US-Cent je Aktie.", 469.0, "US cent per share", "US cent per share"),
    ("atteint 3,49 dollars par action.", 3.49, "US cent per share", "USD per share"), ("came to -239.", -239.0, "US cent per share", None), ("", 1.0, "USD", None), (None, 1.0, "USD", None), ("x $5", None, "USD", None),
]


@pytest.mark.parametrize("case", TEXTS)
def test_text_units(case):
    text, value, common, want = case
    assert text_unit(text, value, common) == want


def test_far_units_and_long_numbers():
    assert text_unit("paid $" + " " * 100 + "(7.25)", 7.25, "US cent per share") == "USD per share"
    assert text_unit("ratio of" + " " * 60 + "0.25", 0.25, "basis point") == "fraction"
    assert text_unit("came to 7.25" + " " * 200 + "million", 7.25, "USD") == "USD million"
    digits = "1 " + " ".join(["000"] * 14)
    assert text_unit(f"USD {digits} outright", 1e42, "USD") == "USD"  # 15 groups
    assert text_unit(" ".join(["123"] * 20_000) + " 999 million", 999.0, "USD") == "USD million"
    assert text_unit("999 999 999.9999999999 dollars", 1e9, "USD") == "USD"


def test_long_text():
    assert text_unit("1,5 ".join(["x"] * 50_000) + " $7.25 million", 7.25, "USD") == "USD million"


def test_claims(spark):
    sources = spark.createDataFrame([("a.rev", "rev", "USD million", "USD"), ("b.rev", "rev", None, "USD"), ("c.m", "m", "fraction", "basis point"), ("d.eps", "eps", None, "US cent per share")], "numeric_source string, measure string, declared_unit string, common_unit string")
    rows = [
        ("1", "x", True, 240.2, "a.rev@3"), ("2", "x", True, 0.24, "a.rev[USD bn]"), ("3", "x", True, 240.0, "a.rev#unit=kUSD"), ("4", "about $5 million", True, 5.0, "b.rev@2.1"), ("5", "about 5", True, 5.0, "b.rev"),
        ("6", "x", True, 12.5, "c.m[%]"), ("7", "x", True, 0.125, "c.m"), ("8", "x", False, 1.0, "a.rev"), ("9", "x", True, None, "a.rev"), ("10", "x", True, 1.0, "zz"), ("11", "x", None, 1.0, "a.rev"), ("12", None, True, 7.0, "d.eps#cents"),
        ("13", "x", True, float("inf"), "a.rev"), ("14", "x", True, 1.0, None), ("1", "x", True, 240.2, "a.rev@3"), ("15", "x", True, 2.0, "d.eps#pct"),
    ]
    got = {r.rec_id: (r.common_unit, r.common_value) for r in claim_units(spark.createDataFrame(rows, "claim_id string, text string, is_numeric boolean, numeric_value double, numeric_source string"), sources).collect()}
    assert got == {"1": ("USD", 240_200_000), "2": ("USD", 240_000_000), "3": ("USD", 240_000), "4": ("USD", 5_000_000), "6": ("basis point", 1250), "7": ("basis point", 1250), "12": ("US cent per share", 7)}

import datetime as dt
from collections import namedtuple

import pytest

from pitlake.operators.books import paper, paper_books, sessions_of

Row = namedtuple("Row", "key day opens closes before prices stays")


def d(n):
    return dt.date(2020, 1, n)


def test_book():
    step = paper(1000.0, 0.01, 0.3, 2)()
    # two names at 10 and 40: 500 / 10.1 = 49 and 500 / 40.4 = 12 shares
    key, _, equity, cash, shares, traded, halted = step(Row("k", d(1), [10.0, 40.0], [11.0, 40.0], [None, None], [], []))
    assert shares == 61 and traded == 49 * 10 + 12 * 40 and cash == pytest.approx(1000 - traded * 1.01) and equity == pytest.approx(cash + 49 * 11 + 12 * 40) and not halted
    # the first stays, the second leaves at 30, a third can't be bought
    key, _, equity, left, shares, traded, halted = step(Row("k", d(2), [10.0, None], [5.0, None], [0, None], [10.0, 30.0], [True, False]))
    there = cash + 49 * 10 + 12 * 30 - 0.01 * 12 * 30
    n = int(there / 2 / 10.1)
    assert shares == n and traded == pytest.approx(360 + abs(n - 49) * 10) and left == pytest.approx(there - n * 10 - 0.01 * abs(n - 49) * 10) and left >= 0
    # in a deep fall all is sold and nothing bought any more
    assert step(Row("k", d(3), [1.0, 1.0], [1.0, 1.0], [0, 1], [1.0, 0.0], [True, True]))[6]
    out = step(Row("k", d(4), [1.0], [1.0], [0], [1.0, 1.0], [True, False]))
    assert out[4] == 0 and out[2] == out[3]


def test_sessions(spark):
    targets = [("b", d(1), "x", 1), ("b", d(1), "y", 2), ("b", d(2), "y", 1), ("b", d(2), "z", 2), ("c", d(2), "x", 1)]
    bars = [(d(1), "x", 10.0, 11.0), (d(1), "y", 20.0, 21.0), (d(2), "y", 22.0, 23.0), (d(2), "q", 1.0, 1.0)]
    s = sessions_of(spark.createDataFrame(targets, "book string, day date, name string, place int"), spark.createDataFrame(bars, "day date, name string, open double, close double"), "book", "day", "name", "place")
    got = {(r.key, r.day.day): r for r in s.collect()}
    assert sorted(got) == [("b", 1), ("b", 2), ("c", 2)]
    r = got["b", 2]
    assert (r.opens, r.closes, r.before, r.prices, r.stays) == ([22.0, None], [23.0, None], [1, None], [11.0, 22.0], [False, True])  # x had no bar: its last close
    assert (got["b", 1].before, got["b", 1].prices) == ([None, None], []) and got["c", 2].opens == [None]
    books = paper_books(s, "string", places=2)
    assert books.count() == 3 and paper_books(s.limit(0), "string").count() == 0

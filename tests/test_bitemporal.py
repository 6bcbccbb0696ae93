import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitlake.operators.bitemporal import locate, rectangles

DAY0 = dt.date(2010, 1, 1)
FACTS = "fact_id bigint, cik bigint, period_end date, first_filed date, entity string"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def brute(facts, events, latest):
    out = {}
    for eid, cik, at in events:
        if cik is None or at is None:
            continue
        best = [
            f for f in facts
            if None not in f[:4] and f[1] == cik and f[3] < at and (latest or f[2] <= at)
        ]
        if best:
            out[eid] = min(best, key=lambda f: (-f[2].toordinal(), -f[3].toordinal(), f[0]))[0]
    return out


@pytest.mark.parametrize("latest", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, latest, seed):
    r = random.Random(seed)
    facts = []
    for i in range(1500):
        cik = r.choice([1, 1, 1, 2, 3, 4, 5])  # one entity holds a third and more
        p = r.randrange(0, 4000, 90)
        facts.append((i, cik, day(p), day(p + r.choice([-50, 0, 20, 20, 45, 400, 1500])), "x"))
    facts += facts[:50] + [(9001, 1, None, day(5), "x"), (9002, None, day(5), day(6), "x"), (9003, 2, day(5), None, "x"), (None, 2, day(3900), day(3901), "x")]
    events = [(i, r.choice([1, 1, 2, 3, 6, None]), day(r.randrange(-50, 6500))) for i in range(2000)] + [(5000, 1, None)]
    f = spark.createDataFrame(facts, FACTS)
    e = spark.createDataFrame([(a, b, c, "v", 7) for a, b, c in events], "eid int, cik bigint, at date, entity string, r0 int")
    got = locate(e, "cik", F.col("at"), rectangles(f, "cik", "period_end", "first_filed", "fact_id", block_days=512), None if latest else F.col("at")).collect()
    assert {x.eid: x.fact_id for x in got} == brute(facts, events, latest)
    assert len(got) == len({x.eid for x in got})


def test_rectangles_are_disjoint(spark):
    facts = [(1, 1, day(0), day(30), "x"), (2, 1, day(90), day(120), "x"), (3, 1, day(0), day(200), "x"), (4, 1, day(45), day(3000), "x")]
    rows = rectangles(spark.createDataFrame(facts, FACTS), "cik", "period_end", "first_filed", "fact_id").collect()
    for i, a in enumerate(rows):
        assert a.v0 < a.v1 and a.r0 < a.r1
        for b in rows[i + 1 :]:
            assert not (a.v0 < b.v1 and b.v0 < a.v1 and a.r0 < b.r1 and b.r0 < a.r1), (a, b)


def test_empty_and_repeated(spark):
    f, none = spark.createDataFrame([(1, 1, day(0), day(1), "x")], FACTS), spark.createDataFrame([], FACTS)
    e = spark.createDataFrame([(1, 1, day(9))] * 2, "eid int, cik bigint, at date")
    rect = lambda x: rectangles(x, "cik", "period_end", "first_filed", "fact_id")
    assert locate(e, "cik", F.col("at"), rect(none)).count() == 0
    assert locate(e.limit(0), "cik", F.col("at"), rect(f)).count() == 0
    assert locate(e, "cik", F.col("at"), rect(f)).count() == 2
    same_day = spark.createDataFrame([(1, 1, day(1))], "eid int, cik bigint, at date")
    assert locate(same_day, "cik", F.col("at"), rect(f)).count() == 0  # filed on that day: not yet known


def test_dates_at_the_end_of_time(spark):
    """9999-12-31 is a date like any other, on either axis and for events."""
    end = dt.date(9999, 12, 31)
    facts = [(1, 1, day(0), day(1), "x"), (2, 1, end, day(5), "x"), (3, 1, day(10), end, "x"), (4, 1, dt.date(1, 1, 1), dt.date(1, 1, 2), "x")] + [(10 + k, 1, day(k), day(400 * k), "x") for k in range(20)]
    events = [(1, 1, day(3)), (2, 1, end), (3, 1, day(6)), (4, 1, dt.date(1500, 1, 1)), (5, 1, dt.date(1, 1, 2))]
    f, e = spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, "eid int, cik bigint, at date")
    rects = rectangles(f, "cik", "period_end", "first_filed", "fact_id")
    assert rects.count() < 500
    for latest in (True, False):
        got = {x.eid: x.fact_id for x in locate(e, "cik", F.col("at"), rects, None if latest else F.col("at")).collect()}
        assert got == brute(facts, events, latest), latest

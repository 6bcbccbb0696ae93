import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitlake.operators.asof import as_of, asof_join, calendar, entry_day, guarded, known


def d(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("slots", [False, True])
def test_asof_against_brute_force(spark, strict, slots):
    r = random.Random(2)
    right = [(r.choice("hhhab"), d(r.randrange(900)), float(i), r.choice([None, "s"])) for i in range(300)] + [("h", None, 1.0, "s"), (None, d(1), 1.0, "s")]
    left = [(i, r.choice(["h", "h", "a", "b", "z", None]), r.choice([d(r.randrange(-20, 950)), None]), "clash") for i in range(400)]
    le = spark.createDataFrame(left, "id int, k string, t date, _x string")
    ri = spark.createDataFrame(right, "k string, t date, v double, w string")
    got = asof_join(le, ri, ["k"], "t", "t", ["v", "w"], strict, F.year("_t") if slots else None).collect()
    assert len(got) == len(left)
    for x in got:
        hits = [] if x.t is None else [(b[1], b[2], b[3] or "") for b in right if b[1] is not None and b[0] == x.k and (b[1] < x.t if strict else b[1] <= x.t)]
        if x.k is None:
            continue  # null keys meet each other only
        assert (x.v, x.w) == ((max(hits)[1], max(hits)[2] or None) if hits else (None, None)), x


def test_asof_takes_whole_rows_and_empty_tables(spark):
    le = spark.createDataFrame([(1, "a", d(9))], "id int, k string, t date")
    ri = spark.createDataFrame([("a", d(1), 1.0), ("a", d(2), None)], "k string, t date, v double")
    assert asof_join(le, ri, ["k"], "t", "t", ["v"]).first().v is None  # the last row's value is null: it isn't taken from the one before
    assert asof_join(le, ri.limit(0), ["k"], "t", "t", ["v"]).first().v is None
    assert asof_join(le.limit(0), ri, ["k"], "t", "t", ["v"]).count() == 0


def test_entry_day(spark):
    cal = calendar(spark.createDataFrame([(d(x),) for x in (0, 1, 2, 5, 6, 6)] + [(None,)], "day date"))
    assert [r.idx for r in cal.orderBy("day").collect()] == [0, 1, 2, 3, 4]
    at = lambda day, h, m: dt.datetime.combine(d(day), dt.time(h, m))
    rows = [(1, at(0, 12, 59)), (2, at(0, 13, 0)), (3, at(2, 13, 0)), (4, at(3, 1, 0)), (5, at(6, 14, 0)), (6, None), (7, at(-30, 1, 0)), (8, at(-800, 1, 0))]
    got = {r.id: r.entry for r in entry_day(spark.createDataFrame(rows, "id int, at timestamp"), "at", cal).collect()}
    assert got == {1: d(0), 2: d(1), 3: d(5), 4: d(5), 5: None, 6: None, 7: d(0), 8: d(0)}


def test_cutoff(spark):
    df = spark.createDataFrame([(1, d(1)), (2, d(2)), (3, d(3))], "id int, t date")
    assert known(df, "t").count() == 3
    with as_of(d(2)):
        assert [r.id for r in known(df, "t").collect()] == [1, 2] and [r.id for r in known(df, "t", strict=True).collect()] == [1]
        with as_of(d(1)):
            assert known(df, "t").count() == 1
        late, fine = guarded(df, "t", "feed"), guarded(df.where("id < 3"), "t", "feed")
        assert fine.count() == 2
        with pytest.raises(Exception, match="LookaheadError: feed"):
            late.collect()
        # the filter is part of the plan, before anything else
        assert "<=" in known(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert guarded(df, "t", "feed").count() == 3


def test_the_future_changes_nothing_before(spark):
    from pyspark.sql import Window as W

    from pitlake.functions.columns import average_rank, back, over_rows

    rows = [(s, d(n), float(100 + (n * 7 + s * 13) % 11)) for s in range(5) for n in range(60)]
    w = W.partitionBy("s").orderBy("t")

    def features(x):
        df = spark.createDataFrame(x, "s int, t date, c double").withColumn("r", back("c", 5, w)).withColumn("m", F.avg("c").over(over_rows(w, 10)))
        return {(q.s, q.t): (q.r, q.m, q.k) for q in df.withColumn("k", average_rank("c", "t")).where(F.col("t") <= F.lit(d(40))).collect()}

    assert features(rows) == features([(s, t, c * 10 if t > d(40) else c) for s, t, c in rows])

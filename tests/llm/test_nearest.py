import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from pitlake.llm.nearest import nearest

L, R = "t string, k string, e string, u bigint, bar_id string", "bar_id bigint, e string, u bigint, rec_id int"
TOL = 100


def run(spark, left, right, slot=1000, tol=TOL):
    c = F.col
    x = nearest(spark.createDataFrame(left, L), spark.createDataFrame(right, R), tol, c("t"), c("k"), c("e"), c("u"), c("bar_id"), c("e"), c("u"), slot_us=slot).collect()
    return sorted(((r.rec_table, r.rec_id, r.bar_id) for r in x), key=str)


def brute(left, right, tol=TOL):
    out = set()
    for t, k, e, u, _ in left:
        near = [(abs(b[2] - u), b[2], b[0]) for b in right if e is not None and u is not None and b[1] == e and b[2] is not None and b[0] is not None and abs(b[2] - u) <= tol]
        if near:
            out.add((t, k, min(near)[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, batch):
    r = random.Random(seed)
    pick = lambda: r.choice(["hot", "hot", "hot", "b", "c", "d"])
    right = [(i, pick(), r.randrange(-3000, 20_000), 0) for i in range(800)] + [(900 + i, "tie", 500 + 10 * (i // 3), 0) for i in range(30)]
    left = [(r.choice("xy"), f"r{i}", r.choice([pick(), "none"]), r.randrange(-3200, 20_500), "z") for i in range(600)] + [("x", f"t{i}", "tie", 480 + i, "z") for i in range(150)]
    left += left[:40] + [("x", "n1", None, 5, "z"), ("x", "n2", "hot", None, "z"), ("x", None, "hot", 100, "z")]
    right += right[:40] + [(5000, None, 5, 0), (5001, "hot", None, 0), (None, "hot", 3, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert run(spark, left, right) == brute(left, right)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_limit_and_ties(spark):
    right = [(1, "a", 0, 0), (2, "a", 200, 0), (4, "a", 1000, 0), (3, "a", 1000, 0)]
    left = [("x", "mid", "a", 100, ""), ("x", "at", "a", 300, ""), ("x", "past", "a", 301, ""), ("x", "exact", "a", 1000, "")]
    assert run(spark, left, right) == [("x", "at", 2), ("x", "exact", 3), ("x", "mid", 1)]


def test_slot_edges_and_long_gap(spark):
    right = [(1, "a", 999, 0), (2, "a", 50_000, 0)]
    left = [("x", "next", "a", 1001, ""), ("x", "gap", "a", 25_000, ""), ("x", "slot", "a", 49_950, "")]
    assert run(spark, left, right) == [("x", "next", 1), ("x", "slot", 2)]
    assert run(spark, left, right, slot=1) == [("x", "next", 1), ("x", "slot", 2)]  # a slot is never shorter than the tolerance


def test_empty(spark):
    assert run(spark, [], [(1, "a", 0, 0)]) == [] and run(spark, [("x", "k", "a", 0, "")], []) == []


@pytest.mark.parametrize(("kind", "ids"), [("date", [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]), ("double", [1.5, 2.5]), ("smallint", [3, 4]), ("decimal(20,3)", [decimal.Decimal("1.500"), decimal.Decimal("2.500")]), ("binary", [b"a", b"b"])])
def test_ids_of_any_kind(spark, kind, ids):
    left = spark.createDataFrame([("t", "k1", "e", 100), ("t", "k2", "e", 190), ("t", "k3", "f", 100)], "tag string, key string, e string, us bigint")
    right = spark.createDataFrame([("e", 90, ids[0]), ("e", 200, ids[1])], f"e string, us bigint, id {kind}")
    c = F.col
    got = nearest(left, right, 50, c("tag"), c("key"), c("e"), c("us"), c("id"), c("e"), c("us")).collect()
    assert {r.rec_id: (bytes(r.bar_id) if kind == "binary" else r.bar_id) for r in got} == {"k1": ids[0], "k2": ids[1]}

import datetime as dt
import math
import random

import pytest

SCHEMA = "run_id string, ticker string, as_of timestamp, horizon_days int, predicted_return_pct double, actual_return_pct double, feed string"


def results(spark, tmp_path, rows):
    """A folder with predictions (arm, p in units of 1 / 10,000, up), in this order."""
    data = [(str(i), "x", dt.datetime(2020, 1, 1), 5, 5 * math.log(p / (10_000 - p)), 1.0 if up else -1.0, arm) for i, (arm, p, up) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "backtest_results.parquet"))
    return str(tmp_path)


def test_calibration_means_at_a_tie(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    rng, rows, sums = random.Random(1), [], {}
    for i in range(40):
        units = [rng.randint(2001, 2990) for _ in range(32)]
        units[-1] += (4 - sum(units)) % 8  # 25 / 4 of the sum is then odd: the mean lies halfway between two numbers of six digits
        rows += [(f"a{i}", u, False) for u in units]
        sums[f"a{i}"] = sum(units)
    rows += [("b", u, True) for u in [2629] * 28 + [2630] * 4]
    sums["b"] = 84_132
    folder, db = results(spark, tmp_path, rows), duckdb.connect()
    want = {arm: db.execute("select round(?::double / 320000, 6)", [s]).fetchall()[0][0] for arm, s in sums.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 32):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = e.queries()["calibration_bins"](spark, folder).collect()
            assert {r.arm: r.mean_p for r in got} == want and {(r.bin, r.n) for r in got} == {(2, 32)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("ups", [41, 323, 333])
def test_calibration_rounds_as_sql(spark, tmp_path, ups):
    import duckdb

    import __spark_entry__ as e
    import verify

    folder = results(spark, tmp_path, [("a", 5000, i < ups) for i in range(640)])
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    db.execute(f"create view backtest_results as select * from '{folder}/backtest_results.parquet/*.parquet'")
    df, rel = e.queries()["calibration_bins"](spark, folder), db.sql(e.oracle_sql()["calibration_bins"])
    assert verify.rows(df.columns, [tuple(r) for r in df.collect()]) == verify.rows(rel.columns, rel.fetchall())

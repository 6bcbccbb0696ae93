import datetime as dt

from pyspark.sql import functions as F

from pitlake.streaming import pipelines as p

SCHEMA = "id int, k string, ts timestamp, value double"
T = dt.datetime(2024, 1, 1)


def rows(n):
    return [(i, "ab"[i % 2], T + dt.timedelta(minutes=7 * i), float(i)) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    data = rows(60)
    for i in range(3):
        spark.createDataFrame(data[i * 20 : i * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = p.file_stream(spark, str(tmp_path / "in"), SCHEMA, 1)
    q = p.to_memory(p.tumbling(s, "ts", "30 minutes", "k", late="10 minutes"), "tumble", "complete")
    q.processAllAvailable()
    q.stop()
    want = p.tumbling(spark.createDataFrame(data, SCHEMA), "ts", "30 minutes", "k")
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(spark.table("tumble")) == key(want)


def test_once_each_and_books(spark, tmp_path):
    data = rows(10)
    spark.createDataFrame(data + data[:5], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = p.file_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = p.to_memory(p.once_each(s, ["id"], "ts", "1 hour"), "once")
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 10
    q = p.to_memory(p.running_book(p.file_stream(spark, str(tmp_path / "in"), SCHEMA), "k", "value"), "book", "update")
    q.processAllAvailable()
    q.stop()
    want = {k: (sum(1 for r in data + data[:5] if r[1] == k), sum(r[3] for r in data + data[:5] if r[1] == k)) for k in "ab"}
    assert {r.key: (r.n, r.total) for r in spark.table("book").collect()} == want


def test_append_new_twice(spark, tmp_path):
    path, df = str(tmp_path / "ledger"), spark.createDataFrame(rows(5), SCHEMA)
    write = p.append_new(path, ["id"])
    for batch in (df, df, spark.createDataFrame(rows(7) + rows(2), SCHEMA)):
        write(batch, 0)
    assert spark.read.parquet(path).count() == 7


def test_late(spark):
    df = spark.createDataFrame(rows(4), SCHEMA).withColumn("deadline", F.lit(T + dt.timedelta(minutes=14)))
    fine, late = p.split_late(df, "ts", "deadline")
    assert (fine.count(), late.count()) == (2, 2)

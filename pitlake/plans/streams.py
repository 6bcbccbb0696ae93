"""Windows over event time, deduplication and late rows, as batch queries with the meaning that the streaming ones have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.plans.registry import query
from pitlake.sources.tables import table
from pitlake.streaming.pipelines import sliding, tumbling


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_type, time_bucket(interval 30 minutes, ts) as start, count(*) as n, round(cast(sum(cast(value as decimal(18,4))) as double), 4) as total from events group by 1, 2")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and sums by type and half-hour: the same pipeline that runs on a stream."""
    x = tumbling(_events(spark, folder), "ts", "30 minutes", "event_type")
    return x.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    """with s as (select e.event_type, b.start, e.value from events e, lateral (select time_bucket(interval 15 minutes, e.ts) - to_minutes(15 * k) as start from range(4) t(k)) b) select event_type, start, count(*) as n, round(cast(sum(cast(value as decimal(18,4))) as double), 4) as total from s group by 1, 2"""
)
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of an hour every quarter of an hour."""
    x = sliding(_events(spark, folder), "ts", "1 hour", "15 minutes", "event_type")
    return x.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as new from events), i as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, max(ts) as last, count(*) as n from i group by user_id, k"""
)
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events with less than six hours between them."""
    x = _events(spark, folder).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query(
    """with o as (select event_id, user_id, ts, max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as seen from events) select event_id, coalesce(ts < seen - interval 1 hour, false) as late from o"""
)
def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that come over an hour behind the newest before them, by user, in order of arrival; late ones are marked, not dropped."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return _events(spark, folder).select("event_id", F.coalesce(F.col("ts") < F.max("ts").over(w) - F.expr("interval 1 hour"), F.lit(False)).alias("late"))


@query("select bar_id, epoch_us(min(received_at)) as first_us, epoch_us(max(received_at)) as last_us, count(*) as deliveries from bars group by bar_id having count(*) > 1")
def repeated_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Bars delivered more than once: what an idempotent sink has to fold."""
    return table(spark, folder, "bars").groupBy("bar_id").agg(F.unix_micros(F.min("received_at")).alias("first_us"), F.unix_micros(F.max("received_at")).alias("last_us"), F.count("*").alias("deliveries")).where("deliveries > 1")


@query(
    """with b as (select distinct bar_id, ticker, timestamp from bars), g as (select ticker, timestamp, timestamp - lag(timestamp) over (partition by ticker order by timestamp, bar_id) as gap from b) select ticker, count(*) as n, count(*) filter (where gap > interval 1 day) as long_gaps, epoch_us(max(gap) + timestamp '1970-01-01') as longest_us from g group by ticker"""
)
def series_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Bars, gaps of more than a day and the longest gap of each series; a series is split by month, with its bounds joined on."""
    b = table(spark, folder, "bars").select("bar_id", "ticker", F.unix_micros("timestamp").alias("t")).distinct().withColumn("m", F.trunc(F.timestamp_micros("t"), "month"))
    w = W.partitionBy("ticker", "m").orderBy("t", "bar_id")
    inner = b.select("ticker", "m", "t", (F.col("t") - F.lag("t").over(w)).alias("gap"))
    day = 86_400_000_000
    months = inner.groupBy("ticker", "m").agg(F.count("*").alias("n"), F.count(F.when(F.col("gap") > day, 1)).alias("k"), F.max("gap").alias("g"), F.min("t").alias("a"), F.max("t").alias("z"))
    months = months.withColumn("edge", F.col("a") - F.lag("z").over(W.partitionBy("ticker").orderBy("m")))
    return months.groupBy("ticker").agg(F.sum("n").alias("n"), (F.sum("k") + F.count(F.when(F.col("edge") > day, 1))).alias("long_gaps"), F.max(F.greatest("g", "edge")).alias("longest_us"))


@query(
    """with h as (select event_type as asset, date_trunc('hour', ts) as ts, avg(value) - 20 as rate from events group by 1, 2), w as (select asset, ts, rate, cast(date_trunc('week', ts) as date) as wk from h),
k as (select asset, wk + 7 as wk, avg(rate) as m, count(*) as n from w group by 1, 2), d as (select asset, cast(ts as date) as day, any_value(wk) as wk, sum(rate) as r from w group by 1, 2),
f as (select d.asset, d.day, d.wk, d.r, coalesce(k.n >= 120 and k.m > 0, false) as held from d left join k on k.asset = d.asset and k.wk = d.wk) select asset, day, round(case when held then r / 1.25 else 0 end, 6) as gross, held from f"""
)
def funding_carry(spark: SparkSession, folder: str) -> DataFrame:
    """Daily carry of each type's hourly means, held in weeks after one with 120 hours or more and a positive mean: a state machine that windows can express."""
    h = _events(spark, folder).groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("ts")).agg((F.avg("value") - 20).alias("rate")).withColumn("wk", F.date_trunc("week", "ts").cast("date"))
    k = h.groupBy("asset", F.date_add("wk", 7).alias("wk")).agg(F.avg("rate").alias("m"), F.count("*").alias("n"))
    d = h.groupBy("asset", "wk", F.col("ts").cast("date").alias("day")).agg(F.sum("rate").alias("r")).join(k, ["asset", "wk"], "left")
    held = F.coalesce((F.col("n") >= 120) & (F.col("m") > 0), F.lit(False))
    return d.select("asset", "day", F.round(F.when(held, F.col("r") / 1.25).otherwise(0.0), 6).alias("gross"), held.alias("held"))

"""Views of the test tables that queries share, in Spark and as SQL: monthly bars, a daily index, predictions, filings, intraday bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.sources.tables import table

_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """sym, day, px, qty and the total order of trades."""
    x = table(spark, folder, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("sym"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.struct(*_ORDER).alias("at"),
    )


def bars_m(spark: SparkSession, folder: str) -> DataFrame:
    """One bar for each symbol and month with trades: first, highest, lowest, last price, volume, trades."""
    x = trades(spark, folder).groupBy("sym", F.trunc("day", "month").alias("day"))
    return x.agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum(F.col("qty").cast("bigint")).cast("double").alias("volume"), F.count("*").alias("n")
    )


def px_d(spark: SparkSession, folder: str) -> DataFrame:
    """A daily index over all trades: volume-weighted close, volume, trades."""
    x = trades(spark, folder).groupBy("day").agg(F.sum("amount").cast("double").alias("a"), F.sum(F.col("qty").cast("bigint")).cast("double").alias("volume"), F.count("*").alias("n"))
    return x.select("day", (F.col("a") / F.col("volume")).alias("close"), "volume", "n")


def preds(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions: arm, cutoff (month), sym, made (day), resolve_date, p, ret, up; one for each run with a time and both returns."""
    x = table(spark, folder, "backtest_results").select("run_id", "ticker", "as_of", "horizon_days", "predicted_return_pct", "actual_return_pct", "feed").distinct()
    x = x.where("as_of is not null and predicted_return_pct is not null and actual_return_pct is not null and horizon_days is not null")
    made = F.col("as_of").cast("date")
    return x.select(
        "run_id", F.col("feed").alias("arm"), F.trunc(made, "month").alias("cutoff"), F.col("ticker").alias("sym"), made.alias("made"), F.date_add(made, F.col("horizon_days")).alias("resolve_date"), F.col("horizon_days").alias("h"),
        F.round(1 / (1 + F.exp(-F.col("predicted_return_pct") / 5)), 4).alias("p"), (F.col("actual_return_pct") / 100).alias("ret"), (F.col("actual_return_pct") > 0).alias("up"),
    )


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """series, period_end, val, filed: the distinct facts of each issuer as each source recorded them, which is one series."""
    x = table(spark, folder, "quarters").where("value is not null")
    return x.select("fact_id", F.concat_ws("|", "cik", "source").alias("series"), "period_end", F.col("value").alias("val"), F.col("first_filed").alias("filed")).distinct()


def bars_30m(spark: SparkSession, folder: str) -> DataFrame:
    """Half-hour bars of the events by type: first, highest, lowest, last, mean value, count."""
    x = table(spark, folder, "events").select("event_type", "ts", "value", "event_id")
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800) * 1800)
    at = F.struct("ts", "event_id")
    x = x.groupBy(F.col("event_type").alias("sym"), slot.alias("slot")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("turnover"), F.count("*").alias("n")
    )
    return x.select("*", F.col("slot").cast("date").alias("day"), (F.hour("slot") * 60 + F.minute("slot")).alias("hm"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """A graph of places and parties: src, rel, dst."""
    n, s, c = (table(spark, folder, t) for t in ("nation", "supplier", "customer"))
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("in_region").alias("rel"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    e = e.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("supplies_from").alias("rel"), F.concat(F.lit("n"), "s_nationkey").alias("dst")))
    return e.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.lit("buys_from").alias("rel"), F.concat(F.lit("n"), "c_nationkey").alias("dst")))


SQL = {
    "trades": "select l_suppkey as sym, cast(l_shipdate as date) as day, l_extendedprice / l_quantity as px, l_quantity as qty, cast(l_extendedprice as decimal(18,2)) as amount, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem",
    "bars_m": "select sym, cast(date_trunc('month', day) as date) as day, first(px order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as open, max(px) as high, min(px) as low, last(px order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as close, cast(sum(qty) as double) as volume, count(*) as n from trades group by 1, 2",
    "px_d": "select day, cast(sum(amount) as double) / cast(sum(qty) as double) as close, cast(sum(qty) as double) as volume, count(*) as n from trades group by day",
    "preds": "select run_id, feed as arm, cast(date_trunc('month', as_of) as date) as cutoff, ticker as sym, cast(as_of as date) as made, cast(as_of as date) + horizon_days as resolve_date, horizon_days as h, round(1 / (1 + exp(-predicted_return_pct / 5)), 4) as p, actual_return_pct / 100 as ret, actual_return_pct > 0 as up from (select distinct run_id, ticker, as_of, horizon_days, predicted_return_pct, actual_return_pct, feed from backtest_results) where as_of is not null and predicted_return_pct is not null and actual_return_pct is not null and horizon_days is not null",
    "filings": "select distinct fact_id, concat_ws('|', cik, source) as series, period_end, value as val, first_filed as filed from quarters where value is not null",
    "bars_30m": "select *, cast(slot as date) as day, cast(hour(slot) * 60 + minute(slot) as int) as hm from (select event_type as sym, time_bucket(interval 30 minutes, ts) as slot, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, cast(sum(cast(value as decimal(18,4))) as double) as turnover, count(*) as n from events group by 1, 2)",
    "edges": "select 'n' || n_nationkey as src, 'in_region' as rel, 'r' || n_regionkey as dst from nation union all select 's' || s_suppkey, 'supplies_from', 'n' || s_nationkey from supplier union all select 'c' || c_custkey, 'buys_from', 'n' || c_nationkey from customer",
}
_NEEDS = {"bars_m": ["trades"], "px_d": ["trades"]}


def using(*names: str, recursive: bool = False) -> str:
    """The beginning of a statement with the views named and what they need."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, []), name) if n not in order]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(f"{n} as ({SQL[n]})" for n in order)

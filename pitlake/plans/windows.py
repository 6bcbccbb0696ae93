"""Window queries over monthly, daily and half-hourly bars and the daily index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import ahead, at_least, average_rank, back, clip, correlation, div, over_rows, percent_of, unit_rank, week_end
from pitlake.operators.pairs import closest_pairs
from pitlake.plans.registry import query
from pitlake.plans.views import bars_30m, bars_m, px_d, using
from pitlake.sources.tables import table


def by_sym() -> WindowSpec:
    return W.partitionBy("sym").orderBy("day")


def by_day() -> WindowSpec:
    """Of the index, which is one series of one row a day: the calendar bounds it."""
    return W.partitionBy(F.lit(0)).orderBy("day")


@query(using("bars_m") + " select sym, day, round(open, 9) as open, round(high, 9) as high, round(low, 9) as low, round(close, 9) as close, volume, n from bars_m")
def bars_from_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly bars by first, highest, lowest and last trade."""
    return bars_m(spark, folder).select("sym", "day", *[F.round(c, 9).alias(c) for c in ("open", "high", "low", "close")], "volume", "n")


@query(
    using("bars_m")
    + """, f as (select sym, day, lag(close) over w / lag(close, 12) over w - 1 as mom, lead(close) over w / close - 1 as fwd from bars_m window w as (partition by sym order by day)),
k as (select *, rank() over (partition by day order by mom) + (count(*) over (partition by day, mom) - 1) / 2.0 as rm, rank() over (partition by day order by fwd) + (count(*) over (partition by day, fwd) - 1) / 2.0 as rf
  from f where mom is not null and fwd is not null)
select day, count(*) as n, round(corr(rm, rf), 6) as ic from k group by day having count(*) >= 20 and min(rm) < max(rm) and min(rf) < max(rf)"""
)
def momentum_rank_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation by month of 12-1 momentum with the next month's return."""
    x = bars_m(spark, folder).select("sym", "day", (div(F.lag("close", 1).over(by_sym()), F.lag("close", 12).over(by_sym())) - 1).alias("mom"), ahead("close", 1, by_sym()).alias("fwd"))
    x = x.where("mom is not null and fwd is not null").select("day", average_rank("mom", "day").alias("rm"), average_rank("fwd", "day").alias("rf"))
    return x.groupBy("day").agg(F.count("*").alias("n"), F.round(correlation("rm", "rf"), 6).alias("ic")).where("n >= 20 and ic is not null")


@query(
    using("bars_m")
    + """, r as (select *, close / lag(close) over w - 1 as r from bars_m window w as (partition by sym order by day))
select sym, day, round(close / lag(close, 1) over w - 1, 6) as r1, round(close / lag(close, 3) over w - 1, 6) as r3, round(close / lag(close, 12) over w - 1, 6) as r12,
  case when count(close) over h >= 10 then round(close / max(close) over h, 6) end as to_high, case when count(r) over s >= 4 then round(stddev_samp(r) over s, 6) end as vol6,
  round(close / avg(close) over s - 1, 6) as gap6, round(avg(close) over e, 6) as mean_so_far
from r window w as (partition by sym order by day), h as (partition by sym order by day rows 11 preceding), s as (partition by sym order by day rows 5 preceding), e as (partition by sym order by day rows unbounded preceding)"""
)
def feature_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Lagged returns, distance from the high, rolling deviation, gap to the rolling and expanding mean."""
    x = bars_m(spark, folder).withColumn("r", back("close", 1, by_sym()))
    h, s = over_rows(by_sym(), 12), over_rows(by_sym(), 6)
    return x.select(
        "sym", "day", F.round("r", 6).alias("r1"), F.round(back("close", 3, by_sym()), 6).alias("r3"), F.round(back("close", 12, by_sym()), 6).alias("r12"),
        at_least(F.round(F.col("close") / F.max("close").over(h), 6), "close", h, 10).alias("to_high"), at_least(F.round(F.stddev_samp("r").over(s), 6), "r", s, 4).alias("vol6"),
        F.round(F.col("close") / F.avg("close").over(s) - 1, 6).alias("gap6"), F.round(F.avg("close").over(by_sym().rowsBetween(W.unboundedPreceding, 0)), 6).alias("mean_so_far"),
    )


@query(
    using("bars_m")
    + """, r as (select *, close / lag(close) over (partition by sym order by day) - 1 as r from bars_m)
select sym, day, case when sum(abs(r)) over w > 0 then round(100 * sum(greatest(r, 0)) over w / sum(abs(r)) over w, 4) end as rsi, round(stddev_pop(r) over w * sqrt(12), 6) as vol, round(sqrt(avg(r * r) over w), 6) as rms
from r window w as (partition by sym order by day rows 13 preceding) qualify count(r) over w >= 12"""
)
def rsi_vol(spark: SparkSession, folder: str) -> DataFrame:
    """Relative strength of the last 14 moves, and their population and mean-zero deviation."""
    w = over_rows(by_sym(), 14)
    x = bars_m(spark, folder).withColumn("r", back("close", 1, by_sym())).withColumn("k", F.count("r").over(w))
    up, size = F.sum(F.greatest("r", F.lit(0.0))).over(w), F.sum(F.abs("r")).over(w)
    x = x.select(
        "sym", "day", "k", F.round(100 * div(up, size), 4).alias("rsi"), F.round(F.stddev_pop("r").over(w) * F.lit(math.sqrt(12)), 6).alias("vol"), F.round(F.sqrt(F.avg(F.col("r") * F.col("r")).over(w)), 6).alias("rms")
    )
    return x.where("k >= 12").drop("k")


@query(
    using("bars_m")
    + """, m as (select day, avg(close) as mc from bars_m group by day), r as (select sym, day, close / lag(close) over (partition by sym order by day) - 1 as r from bars_m),
q as (select day, mc / lag(mc) over (order by day) - 1 as rm from m), j as (select sym, day, r, rm from r join q using (day) where r is not null and rm is not null)
select sym, day, round(covar_samp(r, rm) over w / nullif(var_samp(rm) over w, 0), 4) as beta, round(sqrt(greatest(0, var_samp(r) over w - pow(covar_samp(r, rm) over w, 2) / nullif(var_samp(rm) over w, 0))), 4) as idio,
  round(regr_slope(r, rm) over w, 4) as slope from j window w as (partition by sym order by day rows 23 preceding) qualify count(*) over w >= 12"""
)
def rolling_beta(spark: SparkSession, folder: str) -> DataFrame:
    """Beta and residual deviation against the market over the last 24 months."""
    b = bars_m(spark, folder)
    market = b.groupBy("day").agg(F.avg("close").alias("mc")).select("day", back("mc", 1, by_day()).alias("rm"))
    x = b.select("sym", "day", back("close", 1, by_sym()).alias("r")).join(market, "day").where("r is not null and rm is not null")
    w = over_rows(by_sym(), 24)
    x = x.select("sym", "day", "r", "rm", F.count("*").over(w).alias("k"), F.covar_samp("r", "rm").over(w).alias("c"), F.var_samp("rm").over(w).alias("vm"), F.var_samp("r").over(w).alias("v"), F.regr_slope("r", "rm").over(w).alias("s"))
    idio = F.sqrt(F.greatest(F.lit(0.0), F.col("v") - div(F.col("c") * F.col("c"), F.col("vm"))))
    return x.where("k >= 12").select("sym", "day", F.round(div(F.col("c"), F.col("vm")), 4).alias("beta"), F.round(idio, 4).alias("idio"), F.round("s", 4).alias("slope"))


@query(
    using("bars_m")
    + """, f as (select sym, day, close / lag(close, 3) over w - 1 as a, volume / lag(volume, 1) over w - 1 as b from bars_m window w as (partition by sym order by day)),
k as (select sym, day, case when a is not null then rank() over (partition by day, a is null order by a) + (count(*) over (partition by day, a) - 1) / 2.0 end as ra, case when b is not null then rank() over (partition by day, b is null order by b) + (count(*) over (partition by day, b) - 1) / 2.0 end as rb,
  count(a) over (partition by day) as na, count(b) over (partition by day) as nb, a, avg(a) over (partition by day) as ma, stddev_samp(a) over (partition by day) as sa, row_number() over (partition by day order by a nulls last, sym) as ord, count(*) over (partition by day) as n from f)
select sym, day, round(ra / nullif(na, 0), 6) as pct, round((ra - 1) / greatest(na - 1, 1), 6) as unit, round((ord - 1) / greatest(n - 1, 1), 6) as ordinal, case when a is not null and sa <> 0 then round(least(greatest((a - ma) / sa, -3), 3), 4) + 0.0 end as z,
  round((coalesce((ra - 1) / greatest(na - 1, 1), 0.5) + 1 - coalesce((rb - 1) / greatest(nb - 1, 1), 0.5)) / 2, 6) as score from k"""
)
def anomaly_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-sectional ranks of several kinds, z-score and a composite of signed ranks, 0.5 where one is missing."""
    x = bars_m(spark, folder).select("sym", "day", back("close", 3, by_sym()).alias("a"), back("volume", 1, by_sym()).alias("b"))
    day = W.partitionBy("day")
    x = x.select(
        "sym", "day", "a", percent_of("a", "day").alias("pct"), unit_rank("a", "day").alias("ua"), unit_rank("b", "day").alias("ub"), (F.row_number().over(day.orderBy(F.asc_nulls_last("a"), "sym")) - 1).alias("place"),
        F.count("*").over(day).alias("n"), F.avg("a").over(day).alias("m"), F.stddev_samp("a").over(day).alias("s"),
    )
    half = F.lit(0.5)
    return x.select(
        "sym", "day", F.round("pct", 6).alias("pct"), F.round("ua", 6).alias("unit"), F.round(F.col("place") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("ordinal"), (F.round(clip(div(F.col("a") - F.col("m"), F.col("s")), -3, 3), 4) + 0.0).alias("z"),
        F.round((F.coalesce("ua", half) + 1 - F.coalesce("ub", half)) / 2, 6).alias("score"),
    )


@query(
    using("px_d")
    + """, r as (select day, close / lag(close) over (order by day) - 1 as r from px_d) select cast(year(day) as int) as year, cast(month(day) as int) as month, round(product(1 + r) - 1, 6) as ret, count(*) as n from r where r is not null group by 1, 2"""
)
def period_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Returns compounded by calendar month."""
    r = px_d(spark, folder).select("day", back("close", 1, by_day()).alias("r")).where("r is not null")
    return r.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.round(F.product(1 + F.col("r")) - 1, 6).alias("ret"), F.count("*").alias("n"))


_DAILY = ", r as (select day, close, close / lag(close) over (order by day) - 1 as r from px_d), g as (select day, r, close / first_value(close) over (order by day) as eq from r), d as (select *, eq / max(eq) over (order by day rows unbounded preceding) - 1 as dd from g)"


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    x = px_d(spark, folder).select("day", back("close", 1, by_day()).alias("r"), (F.col("close") / F.first("close").over(by_day())).alias("eq"))
    return x.withColumn("dd", F.col("eq") / F.max("eq").over(by_day().rowsBetween(W.unboundedPreceding, 0)) - 1)


@query(
    using("px_d") + _DAILY
    + """, a as (select count(r) as n, avg(r) as m, stddev_samp(r) as s, stddev_pop(r) as sp, min(dd) as mdd, avg(case when r > 0 then 1.0 else 0.0 end) filter (where r is not null) as hit, sqrt(avg(least(r, 0) * least(r, 0)) filter (where r is not null)) as down, sqrt(avg(dd * dd)) as ulcer,
  quantile_cont(r, 0.05) as q05, quantile_cont(r, 0.95) as q95, max(eq) filter (where day = (select max(day) from d)) as last, avg(pow((r - (select avg(r) from d)), 3)) as m3, avg(pow((r - (select avg(r) from d)), 4)) as m4 from d),
c as (select avg(r) as cvar from d, a where r <= q05)
select n, round(m * 252, 4) as mean, round(s * sqrt(252), 4) as vol, round(m / s * sqrt(252), 4) as sharpe, round(m / down * sqrt(252), 4) as sortino, round(mdd, 6) as max_dd, round(hit, 6) as hit, round(ulcer, 6) as ulcer, round(-q05, 6) as var95, round(-cvar, 6) as cvar95, round(q95 / abs(q05), 4) as tail,
  round(pow(last, 252.0 / n) - 1, 6) as cagr, round(m3 / pow(sp, 3) * sqrt(n * (n - 1.0)) / (n - 2), 3) as skew, round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / pow(sp, 4) - 3) + 6), 3) as kurt from a, c"""
)
def tear_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Growth, deviation, downside, tail and shape of the daily returns; skewness and kurtosis are bias-corrected."""
    d = _daily(spark, folder)
    low = d.agg(F.percentile("r", 0.05)).first()[0]  # one number
    q05 = F.lit(float(low if low is not None else 0.0))
    a = d.agg(
        F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.min("dd").alias("mdd"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("hit"),
        F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), 2)))).alias("down"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"), F.percentile("r", 0.95).alias("q95"),
        F.avg(F.when(F.col("r") <= q05, F.col("r"))).alias("cvar"), F.max_by("eq", "day").alias("last"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"),
    )
    n = F.col("n")
    year = math.sqrt(252)
    return a.select(
        "n", F.round(F.col("m") * 252, 4).alias("mean"), F.round(F.col("s") * year, 4).alias("vol"), F.round(div(F.col("m"), F.col("s")) * year, 4).alias("sharpe"), F.round(div(F.col("m"), F.col("down")) * year, 4).alias("sortino"),
        F.round("mdd", 6).alias("max_dd"), F.round("hit", 6).alias("hit"), F.round("ulcer", 6).alias("ulcer"), F.round(-q05, 6).alias("var95"), F.round(-F.col("cvar"), 6).alias("cvar95"), F.round(div(F.col("q95"), F.abs(q05)), 4).alias("tail"),
        F.round(F.pow("last", 252 / n) - 1, 6).alias("cagr"), F.round(F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2), 3).alias("skew"), F.round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.col("g2") + 6), 3).alias("kurt"),
    )


@query(using("px_d") + _DAILY + " select day, round(eq, 6) as eq, round(dd, 6) as dd from d")
def drawdown_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Equity and its distance from the running maximum."""
    return _daily(spark, folder).select("day", F.round("eq", 6).alias("eq"), F.round("dd", 6).alias("dd"))


@query(
    using("px_d") + _DAILY
    + """, f as (select *, dd < 0 as under, case when (dd < 0) is distinct from lag(dd < 0) over (order by day) then 1 else 0 end as new from d), i as (select *, sum(new) over (order by day) as island from f)
select min(day) as start, max(day) as finish, count(*) as days, round(min(dd), 6) as depth, first(day order by dd, day) as trough from i where under group by island"""
)
def drawdown_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches below the running maximum, with depth and trough: gaps and islands."""
    x = _daily(spark, folder).withColumn("under", F.col("dd") < 0)
    x = x.withColumn("new", (~F.col("under").eqNullSafe(F.lag("under").over(by_day()))).cast("int")).withColumn("island", F.sum("new").over(by_day()))
    return x.where("under").groupBy("island").agg(F.min("day").alias("start"), F.max("day").alias("finish"), F.count("*").alias("days"), F.round(F.min("dd"), 6).alias("depth"), F.min_by("day", F.struct("dd", "day")).alias("trough")).drop("island")


@query(
    using("px_d")
    + """, k as (select day, row_number() over (partition by date_trunc('month', day) order by day) as up, row_number() over (partition by date_trunc('month', day) order by day desc) as down, close / lag(close) over (order by day) - 1 as r from px_d),
x as (select *, up <= 3 or down = 1 as tom from k) select day, tom, tom and not coalesce(lag(tom) over (order by day), false) as enters, tom and not coalesce(lead(tom) over (order by day), false) as leaves from x"""
)
def turn_of_month(spark: SparkSession, folder: str) -> DataFrame:
    """The last and first three trading days of each month, and where such a run begins and ends."""
    month = W.partitionBy(F.trunc("day", "month"))
    x = px_d(spark, folder).select("day", ((F.row_number().over(month.orderBy("day")) <= 3) | (F.row_number().over(month.orderBy(F.desc("day"))) == 1)).alias("tom"))
    return x.select("day", "tom", (F.col("tom") & ~F.lag("tom", 1, False).over(by_day())).alias("enters"), (F.col("tom") & ~F.lead("tom", 1, False).over(by_day())).alias("leaves"))


_DAYS = """with b as (select distinct bar_id, ticker, timestamp as t, open, close from bars where ticker is not null), d as (select ticker, cast(t as date) as day, arg_min(open, struct_pack(t := t, i := bar_id)) filter (where open > 0) as open, arg_max(close, struct_pack(t := t, i := bar_id)) filter (where close > 0) as close from b group by 1, 2),
x as (select *, close / lag(close) over (partition by ticker order by day) - 1 as r from d where close is not null and open is not null)"""


def days_of(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, day, open, close, r: the first open and last close above 0 of each day, with the change on the day before; one row for each day, however many bars."""
    b = table(spark, folder, "bars").where("ticker is not null").select("bar_id", "ticker", "timestamp", "open", "close").distinct()
    at = F.struct("timestamp", "bar_id")
    pick = lambda f, c: f(c, F.when(F.col(c) > 0, at))
    d = b.groupBy("ticker", F.col("timestamp").cast("date").alias("day")).agg(pick(F.min_by, "open").alias("open"), pick(F.max_by, "close").alias("close")).where("open is not null and close is not null")
    return d.withColumn("r", back("close", 1, W.partitionBy("ticker").orderBy("day")))


@query(
    _DAYS
    + """, z as (select *, stddev_samp(r) over h as s, count(r) over h as k, lead(close, 5) over w / lead(open) over w - 1 as later from x window w as (partition by ticker order by day), h as (partition by ticker order by day rows between 60 preceding and 1 preceding))
select ticker, day, round(r, 6) as r, round(r / s, 3) as z, round(later, 6) as later from z where k >= 20 and s > 0 and abs(r) > 4 * s"""
)
def spike_triggers(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which a ticker moves by over four deviations of the 60 days before, of which 20 must be known, with the return of the next five days from the next open."""
    w = W.partitionBy("ticker").orderBy("day")
    h = w.rowsBetween(-60, -1)
    x = days_of(spark, folder)
    x = x.select("ticker", "day", "r", F.stddev_samp("r").over(h).alias("s"), F.count("r").over(h).alias("k"), (F.lead("close", 5).over(w) / F.lead("open").over(w) - 1).alias("later")).where("k >= 20 and s > 0 and abs(r) > 4 * s")
    return x.select("ticker", "day", F.round("r", 6).alias("r"), F.round(F.col("r") / F.col("s"), 3).alias("z"), F.round("later", 6).alias("later"))


@query(
    _DAYS
    + """, z as (select *, close / lag(close, 20) over w - 1 as m, avg(close) over m100 as a, count(*) over m100 as n100, stddev_samp(r) over m60 as s, count(r) over m60 as k, row_number() over w as i, avg(r) over (partition by ticker order by day rows between 19 preceding and current row) as mean from x
  window w as (partition by ticker order by day), m100 as (partition by ticker order by day rows between 99 preceding and current row), m60 as (partition by ticker order by day rows between 59 preceding and current row))
select ticker, day, m > 0 and close > a as on_, round(case when m > 0 and close > a then least(1, 0.3 / greatest(s * sqrt(365), 0.05)) else 0 end, 6) as weight, round(close * pow(1 + mean, 5), 6) as projected from z where i >= 120"""
)
def trend_state(spark: SparkSession, folder: str) -> DataFrame:
    """From 120 closes on: whether a ticker rose over 20 days and stands above its mean of 100, the weight by its deviation of 60 days, not below 5 % a year, and the close projected five days on by the mean of 20 changes."""
    w = W.partitionBy("ticker").orderBy("day")
    x = days_of(spark, folder)
    x = x.select("ticker", "day", "close", "r", back("close", 20, w).alias("m"), F.avg("close").over(over_rows(w, 100)).alias("a"), F.stddev_samp("r").over(over_rows(w, 60)).alias("s"), F.avg("r").over(over_rows(w, 20)).alias("mean"), F.row_number().over(w).alias("i")).where("i >= 120")
    on = (F.col("m") > 0) & (F.col("close") > F.col("a"))
    weight = F.when(on, F.least(F.lit(1.0), 0.3 / F.greatest(F.col("s") * math.sqrt(365), F.lit(0.05)))).otherwise(0.0)
    return x.select("ticker", "day", on.alias("on_"), F.round(weight, 6).alias("weight"), F.round(F.col("close") * F.pow(1 + F.col("mean"), 5), 6).alias("projected"))


@query(
    using("bars_30m")
    + """, k as (select *, row_number() over (partition by sym, day order by slot desc) as back, count(*) over (partition by sym, day) as bars from bars_30m), d as (select sym, day, any_value(bars) as n, max(case when back = 1 then open end) as o, max(case when back = 1 then close end) as c, max(case when back = 2 then close end) as before from k group by 1, 2),
p as (select *, lag(c) over (partition by sym order by day) as close0 from d) select sym, day, cast(sign(before / nullif(close0, 0) - 1) as int) as side, round(sign(before / nullif(close0, 0) - 1) * (c / nullif(o, 0) - 1), 6) + 0.0 as ret from p where n >= 2 and close0 is not null"""
)
def last_half_hour(spark: SparkSession, folder: str) -> DataFrame:
    """The last half-hour of each session in the direction that the session had against the close before it until then."""
    s = W.partitionBy("sym", "day")
    k = bars_30m(spark, folder).select("sym", "day", "open", "close", F.row_number().over(s.orderBy(F.desc("slot"))).alias("back"))
    at = lambda n, c: F.max(F.when(F.col("back") == n, F.col(c)))
    d = k.groupBy("sym", "day").agg(F.count("*").alias("n"), at(1, "open").alias("o"), at(1, "close").alias("c"), at(2, "close").alias("before"))
    d = d.withColumn("close0", F.lag("c").over(W.partitionBy("sym").orderBy("day"))).where("n >= 2 and close0 is not null")
    side = F.signum(div(F.col("before"), F.col("close0")) - 1)
    return d.select("sym", "day", side.cast("int").alias("side"), (F.round(side * (div(F.col("c"), F.col("o")) - 1), 6) + 0.0).alias("ret"))


@query(using("px_d") + " select cast(day + cast((5 - isodow(day) + 7) % 7 as int) as date) as week, round(last(close order by day), 6) as close, count(*) as n from px_d group by 1")
def weekly_resample(spark: SparkSession, folder: str) -> DataFrame:
    """The last close of each week that ends on a Friday."""
    return px_d(spark, folder).groupBy(week_end(F.col("day")).alias("week")).agg(F.round(F.max_by("close", "day"), 6).alias("close"), F.count("*").alias("n"))


@query(
    using("bars_m")
    + """, r as (select sym, day, close / lag(close) over (partition by sym order by day) - 1 as r from bars_m), v as (select sym, day, stddev_samp(r) over w as s, count(r) over w as k, r from r window w as (partition by sym order by day rows 11 preceding)),
g as (select *, case when k >= 6 and s > 0 then least(0.1 / (s * sqrt(12)), 2) * sign(r) end as w from v) select sym, day, round(w, 6) as w, round(abs(coalesce(w, 0) - coalesce(lag(w) over (partition by sym order by day), 0)), 6) as turnover from g"""
)
def vol_scaled_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Trend weights scaled to a target deviation, with their turnover."""
    f = over_rows(by_sym(), 12)
    x = bars_m(spark, folder).select("sym", "day", back("close", 1, by_sym()).alias("r")).select("sym", "day", "r", F.stddev_samp("r").over(f).alias("s"), F.count("r").over(f).alias("k"))
    x = x.withColumn("w", F.when((F.col("k") >= 6) & (F.col("s") > 0), F.least(0.1 / (F.col("s") * math.sqrt(12)), F.lit(2.0)) * F.signum("r")))
    zero = F.lit(0.0)
    return x.select("sym", "day", F.round("w", 6).alias("w"), F.round(F.abs(F.coalesce("w", zero) - F.coalesce(F.lag("w").over(by_sym()), zero)), 6).alias("turnover"))


@query(
    using("px_d")
    + """, r as (select day, close / lag(close) over (order by day) - 1 as r from px_d), q as (select day, r, quantile_cont(r, 0.9) over w as hi, avg(r) over w as m, stddev_samp(r) over w as s, count(r) over w as k from r window w as (order by day range between interval 90 days preceding and interval 1 day preceding))
select day, round(hi, 6) as hi, round((r - m) / nullif(s, 0), 4) as z from q where k >= 30"""
)
def trailing_days(spark: SparkSession, folder: str) -> DataFrame:
    """Quantile and z-score against the 90 calendar days before."""
    w = W.partitionBy(F.lit(0)).orderBy(F.unix_date("day")).rangeBetween(-90, -1)
    x = px_d(spark, folder).select("day", back("close", 1, by_day()).alias("r"))
    x = x.select("day", "r", F.percentile("r", 0.9).over(w).alias("hi"), F.avg("r").over(w).alias("m"), F.stddev_samp("r").over(w).alias("s"), F.count("r").over(w).alias("k"))
    return x.where("k >= 30").select("day", F.round("hi", 6).alias("hi"), F.round(div(F.col("r") - F.col("m"), F.col("s")), 4).alias("z"))


@query(
    using("bars_m")
    + """, m as (select sym, day, close / lag(close) over (partition by sym order by day) - 1 as r from bars_m), p as (select sym, cast(year(day) as int) as year, month(day) as month, r from m where r is not null)
select sym, year, """ + ", ".join(f"round(max(r) filter (where month = {k}), 6) as m{k}" for k in range(1, 13)) + " from p group by sym, year"
)
def monthly_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """A table of years by months for each symbol."""
    x = bars_m(spark, folder).select("sym", F.year("day").alias("year"), F.month("day").alias("month"), F.round(back("close", 1, by_sym()), 6).alias("r")).where("r is not null")
    x = x.groupBy("sym", "year").pivot("month", list(range(1, 13))).agg(F.max("r"))
    return x.select("sym", "year", *[F.col(str(k)).alias(f"m{k}") for k in range(1, 13)])


@query(
    using("px_d")
    + ", r as (select close / lag(close) over (order by day) - 1 as r from px_d) select cast(least(greatest(floor((r + 0.1) / 0.01), 0), 19) as int) as bin, count(*) as n from r where r between -0.1 and 0.1 group by 1"
)
def return_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of returns between fixed edges, the last bin closed."""
    r = px_d(spark, folder).select(back("close", 1, by_day()).alias("r")).where("r between -0.1 and 0.1")
    return r.groupBy(F.least(F.greatest(F.floor((F.col("r") + 0.1) / 0.01), F.lit(0)), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    using("bars_m")
    + """, s as (select b.*, n_regionkey as sector from bars_m b join supplier on s_suppkey = sym join nation on n_nationkey = s_nationkey), f as (select sym, sector, day, close / first_value(close) over (partition by sym order by day) as g from s),
k as (select sym from f group by sym having count(*) >= 12),
p as (select a.sector, a.sym as a, b.sym as b, sum((a.g - b.g) * (a.g - b.g)) as ssd, count(*) as n from f a join f b on a.sector = b.sector and a.day = b.day and a.sym < b.sym where a.sym in (select sym from k) and b.sym in (select sym from k) group by 1, 2, 3)
select cast(sector as bigint) as sector, a, b, round(ssd, 4) as ssd, n from p where n >= 12 qualify row_number() over (partition by sector order by ssd, a, b) <= 5"""
)
def pair_ssd_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five closest pairs of each sector by squared distance of normalised prices, worked out block by block."""
    d = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    x = bars_m(spark, folder).join(d.select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").cast("bigint").alias("sector")), "sym")
    x = x.select("sym", "sector", "day", (F.col("close") / F.first("close").over(by_sym())).alias("g"))
    p = closest_pairs(x, "sector", "sym", "day", "g", 5, 12)
    return p.select("sector", "a", "b", F.round("ssd", 4).alias("ssd"), "n")


@query(
    using("bars_m")
    + """, f as (select sym, day, open / lag(close) over (partition by sym order by day) - 1 as overnight, close / open - 1 as intraday from bars_m), k as (select *, row_number() over (partition by day order by overnight, sym) as lo, row_number() over (partition by day order by overnight desc, sym) as hi, count(*) over (partition by day) as n from f where overnight is not null)
select day, n, round(avg(intraday) filter (where lo <= greatest(1, n // 10)) - avg(intraday) filter (where hi <= greatest(1, n // 10)), 6) as spread from k where n >= 20 group by day, n"""
)
def opening_reversal(spark: SparkSession, folder: str) -> DataFrame:
    """By month: the later move of the tenth that opened lowest, less that of the tenth that opened highest."""
    x = bars_m(spark, folder).select("sym", "day", (div(F.col("open"), F.lag("close").over(by_sym())) - 1).alias("o"), (F.col("close") / F.col("open") - 1).alias("i")).where("o is not null")
    day = W.partitionBy("day")
    x = x.select("day", "i", F.row_number().over(day.orderBy("o", "sym")).alias("lo"), F.row_number().over(day.orderBy(F.desc("o"), "sym")).alias("hi"), F.count("*").over(day).alias("n")).where("n >= 20")
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return x.groupBy("day", "n").agg(F.round(F.avg(F.when(F.col("lo") <= k, F.col("i"))) - F.avg(F.when(F.col("hi") <= k, F.col("i"))), 6).alias("spread"))

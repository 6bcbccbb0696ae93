"""Recipes, rejects, anonymised windows, answers of models, calendars, neighbours in time, resampling and pair trades."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import average_rank, back, clip, correlation, div, last_friday, percent_of, third_friday
from pitlake.functions.quantiles import exact_quantiles
from pitlake.operators.pairs import closest_pairs
from pitlake.operators.recipes import compiled
from pitlake.operators.resampling import difference, intercept, interval, mean, mean_to_deviation, path_cone, slope
from pitlake.plans.registry import query
from pitlake.plans.scores import _RANKED, _ics
from pitlake.plans.views import bars_m, preds, px_d, using
from pitlake.plans.windows import by_day, by_sym
from pitlake.sources.tables import table

_SIGNAL = "+ ret - p + arm:walkbox_utc"


def _rank_sql(x: str) -> str:
    return f"case when {x} is not null then (rank() over (partition by cutoff, {x} is null order by {x}) + (count(*) over (partition by cutoff, {x}) - 1) / 2.0) / nullif(count({x}) over (partition by cutoff), 0) end"


@query(
    using("preds")
    + f", x as (select run_id, cutoff, case when up then ret end as a, p as b, case when arm = 'walkbox_utc' then 1.0 else 0.0 end as c from preds) select run_id, round(coalesce({_rank_sql('a')}, 0.5) - coalesce({_rank_sql('b')}, 0.5) + coalesce({_rank_sql('c')}, 0.5), 9) + 0.0 as score from x"
)
def recipe_score(spark: SparkSession, folder: str) -> DataFrame:
    """A declared signal compiled to percent ranks within months; missing values rank in the middle."""
    x = preds(spark, folder).select("run_id", "cutoff", "arm", F.when(F.col("up"), F.col("ret")).alias("ret"), "p")
    return compiled(x, _SIGNAL, "cutoff").select("run_id", (F.round("score", 9) + 0.0).alias("score"))


@query(
    """with b as (select distinct run_id, ticker, as_of, horizon_days, predicted_return_pct from backtest_results), t as (select distinct ticker from bars), d as (select distinct cast(timestamp as date) as day, ticker from bars),
r as (select b.run_id, case when b.as_of is null or b.predicted_return_pct is null then 'malformed' when abs(b.predicted_return_pct) > 5 then 'out of range' when t.ticker is null then 'unknown ticker' when d.day is null then 'no bar that day' end as reason
  from b left join t using (ticker) left join d on d.ticker = b.ticker and d.day = cast(b.as_of as date)) select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1"""
)
def reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions by the first reason to refuse them; nothing is dropped without being counted."""
    b = table(spark, folder, "backtest_results").select("run_id", "ticker", "as_of", "predicted_return_pct").distinct().withColumn("day", F.col("as_of").cast("date"))
    days = table(spark, folder, "bars").select(F.col("ticker").alias("_t"), F.col("timestamp").cast("date").alias("_d")).distinct()
    names = days.select(F.col("_t").alias("_n")).distinct()
    x = b.join(names, F.col("ticker") == F.col("_n"), "left").join(days, (F.col("ticker") == F.col("_t")) & (F.col("day") == F.col("_d")), "left")
    reason = (
        F.when(F.col("as_of").isNull() | F.col("predicted_return_pct").isNull(), "malformed").when(F.abs("predicted_return_pct") > 5, "out of range")
        .when(F.col("_n").isNull(), "unknown ticker").when(F.col("_d").isNull(), "no bar that day").otherwise("kept")
    )
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    using("bars_m")
    + """, w as (select sym, day, close, row_number() over (partition by sym order by day desc) as back from bars_m where day <= date '2000-06-30') select sym, cast(24 - back as bigint) as step, round(100 * close / last_value(close) over (partition by sym order by back rows between unbounded preceding and unbounded following), 4) as level from w where back <= 24"""
)
def anonymised_window(spark: SparkSession, folder: str) -> DataFrame:
    """The last 24 bars known at a cutoff, without dates, the first set to 100."""
    w = W.partitionBy("sym").orderBy(F.desc("day"))
    x = bars_m(spark, folder).where(F.col("day") <= F.lit("2000-06-30").cast("date")).select("sym", "close", F.row_number().over(w).alias("back")).where("back <= 24")
    first = F.last("close").over(W.partitionBy("sym").orderBy("back").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return x.select("sym", (24 - F.col("back")).cast("bigint").alias("step"), F.round(100 * F.col("close") / first, 4).alias("level"))


@query(
    using("preds")
    + """, q as (select quantile_cont(ret, 0.02) as lo, quantile_cont(ret, 0.98) as hi from preds) select arm, count(*) as n, round(avg(ret), 9) as mean, round(min(ret), 9) as low, round(max(ret), 9) as high from preds, q where ret between lo and hi group by arm"""
)
def tail_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes without the highest and lowest fiftieth."""
    x = preds(spark, folder)
    ends = exact_quantiles(x, [], {"ret": F.col("ret")}, (0.02, 0.98)).first()  # two numbers
    lo, hi = (ends["ret_0"], ends["ret_1"]) if ends else (None, None)
    return x.where(F.col("ret").between(F.lit(lo), F.lit(hi))).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 9).alias("mean"), F.round(F.min("ret"), 9).alias("low"), F.round(F.max("ret"), 9).alias("high"))


@query(
    """with a as (select distinct claim_id, 'p_up: {"p_up": ' || (numeric_value % 1.3) || ', "note": "' || made_by || '"} end' as answer from claims where numeric_value is not null and numeric_value >= 0)
select claim_id, round(coalesce(least(greatest(try_cast(json_extract_string(regexp_extract(answer, '(\\{.*\\})', 1), '$.p_up') as double), 0.01), 0.99), 0.5), 6) as p from a""".replace("\\\\", "\\")
)
def parsed_probability(spark: SparkSession, folder: str) -> DataFrame:
    """The probability in the JSON within an answer, kept within 0.01 to 0.99; 0.5 if none can be read."""
    a = table(spark, folder, "claims").select("claim_id", "numeric_value", "made_by").distinct().where("numeric_value >= 0 and not isnan(numeric_value)")
    a = a.select("claim_id", F.concat(F.lit('p_up: {"p_up": '), (F.col("numeric_value") % 1.3).cast("string"), F.lit(', "note": "'), "made_by", F.lit('"} end')).alias("answer"))
    p = F.expr("try_cast(get_json_object(regexp_extract(answer, '(?s)([{].*[}])', 1), '$.p_up') as double)")
    return a.select("claim_id", F.round(F.coalesce(clip(p, 0.01, 0.99), F.lit(0.5)), 6).alias("p"))


@query(
    """with e as (select event_id, [{'t': ' UP', 'l': -0.1 - value / 50}, {'t': 'down', 'l': -0.5 - (event_id % 7) / 3.0}, {'t': 'Up.', 'l': -3.0}, {'t': 'maybe', 'l': -4.0}] as c from events),
w as (select event_id, list_sum([exp(x.l) for x in c if upper(trim(x.t, ' ._*')) = 'UP']) as up, list_sum([exp(x.l) for x in c if upper(trim(x.t, ' ._*')) = 'DOWN']) as down from e) select event_id, round(up / (up + down), 6) as p, round(up + down, 6) as mass, round(ln(up) - ln(down), 6) as odds from w"""
)
def token_odds(spark: SparkSession, folder: str) -> DataFrame:
    """Probability and log odds of two words from the log probabilities of candidate tokens, spellings of one word summed."""
    e = table(spark, folder, "events").select("event_id", "value")
    entry = lambda t, v: F.struct(F.lit(t).alias("t"), v.cast("double").alias("l"))
    c = F.array(entry(" UP", -0.1 - F.col("value") / 50), entry("down", -0.5 - F.pmod("event_id", F.lit(7)) / 3.0), entry("Up.", F.lit(-3.0)), entry("maybe", F.lit(-4.0)))
    word = lambda w: F.aggregate(F.filter("c", lambda x: F.upper(F.trim(x["t"], F.lit(" ._*"))) == w), F.lit(0.0), lambda a, x: a + F.exp(x["l"]))
    x = e.withColumn("c", c).select("event_id", word("UP").alias("up"), word("DOWN").alias("down"))
    mass = F.col("up") + F.col("down")
    return x.select("event_id", F.round(div(F.col("up"), mass), 6).alias("p"), F.round(mass, 6).alias("mass"), F.round(F.log("up") - F.log("down"), 6).alias("odds"))


@query(
    """with d as (select distinct cast(o_orderdate as date) as day from orders), m as (select day, cast(date_trunc('month', day) as date) as m from d) select day, m + cast((5 - isodow(m) + 7) % 7 as int) + 14 as third, last_day(day) - cast((isodow(last_day(day)) + 2) % 7 as int) as last,
  day + cast(case when isodow(day) >= 5 then 8 - isodow(day) else 1 end as int) as next_weekday, m + cast(case when isodow(m) > 5 then 8 - isodow(m) else 0 end as int) as first_weekday from m"""
)
def expiry_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Third and last Friday of the month, the next weekday and the month's first."""
    d = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    m, wd = F.trunc("day", "month"), F.weekday("day")
    return d.select(
        "day", third_friday(F.col("day")).alias("third"), last_friday(F.col("day")).alias("last"), F.date_add("day", F.when(wd >= 4, 7 - wd).otherwise(1)).alias("next_weekday"),
        F.date_add(m, F.when(F.weekday(m) > 4, 7 - F.weekday(m)).otherwise(0)).alias("first_weekday"),
    )


@query(
    """with o as (select o_orderkey, o_custkey, o_orderdate as t from orders), j as (select a.o_orderkey, b.o_orderkey as prev, row_number() over (partition by a.o_orderkey order by b.t desc, b.o_orderkey desc) as r from o a join o b on b.o_custkey = a.o_custkey and b.t <= a.t - interval 30 days and b.t > a.t - interval 200 days)
select o.o_orderkey, j.prev from o left join j on j.o_orderkey = o.o_orderkey and j.r = 1"""
)
def previous_within(spark: SparkSession, folder: str) -> DataFrame:
    """The customer's last order at least 30 and under 200 days before each: the last value of a range frame, no join of orders with orders."""
    w = W.partitionBy("o_custkey").orderBy(F.unix_date("t")).rangeBetween(-199, -30)
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("t"))
    return o.select("o_orderkey", F.max(F.struct("t", "o_orderkey")).over(w)["o_orderkey"].alias("prev"))


@query(
    using("bars_m")
    + """, m as (select day, avg(close) as mc from bars_m group by day), n as (select s_suppkey as sym, n_regionkey as sector from supplier join nation on n_nationkey = s_nationkey), s as (select sector, day, avg(close) as sc, count(*) as k from bars_m join n using (sym) group by 1, 2)
select b.sym, b.day, round(b.close / coalesce(case when s.k >= 20 then s.sc end, m.mc) - 1, 6) as rel, s.k >= 20 as by_sector from bars_m b join n using (sym) join m using (day) left join s on s.sector = n.sector and s.day = b.day"""
)
def sector_or_market(spark: SparkSession, folder: str) -> DataFrame:
    """Closes against their sector's mean where it has 20 names, else against the market's: one pass of windows in place of two joins."""
    n = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    d = table(spark, folder, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").alias("sector"))  # 25 nations
    day, sec = W.partitionBy("day"), W.partitionBy("day", "sector")
    x = bars_m(spark, folder).join(d, "sym").select("sym", "day", "close", F.avg("close").over(day).alias("mc"), F.avg("close").over(sec).alias("sc"), F.count("*").over(sec).alias("k"))
    return x.select("sym", "day", F.round(F.col("close") / F.when(F.col("k") >= 20, F.col("sc")).otherwise(F.col("mc")) - 1, 6).alias("rel"), (F.col("k") >= 20).alias("by_sector"))


def _r(x: str) -> str:
    return f"rank() over (partition by arm, cutoff order by {x}) + (count(*) over (partition by arm, cutoff, {x}) - 1) / 2.0"


@query(
    using("preds")
    + f""", b as (select arm, cutoff, run_id, ret, p, h, count(*) over (partition by arm, cutoff) as n, {_r('p')} as rp, {_r('h')} as rh, {_r('ret')} as rr from preds), s as (select *, rp + rh as s from b where n >= 10), k as (select *, {_r('s')} as rs from s)
select arm, cutoff, round(corr(rs, rr) - corr(rp, rr), 6) as gain from k group by 1, 2 having min(p) < max(p) and min(h) < max(h) and min(ret) < max(ret) and min(s) < max(s)"""
)
def blend_gain(spark: SparkSession, folder: str) -> DataFrame:
    """What a second signal adds to the rank correlation: that of the summed ranks less that of the first."""
    x = preds(spark, folder).select("arm", "cutoff", "ret", "p", "h", F.count("*").over(W.partitionBy("arm", "cutoff")).alias("n"))
    x = x.where("n >= 10").select("arm", "cutoff", average_rank("p", "arm", "cutoff").alias("rp"), average_rank("h", "arm", "cutoff").alias("rh"), average_rank("ret", "arm", "cutoff").alias("rr"))
    x = x.withColumn("s", F.col("rp") + F.col("rh")).withColumn("rs", average_rank("s", "arm", "cutoff"))
    g = x.groupBy("arm", "cutoff").agg(correlation("rs", "rr").alias("a"), correlation("rp", "rr").alias("b"), correlation("rh", "rr").alias("c")).where("a is not null and b is not null and c is not null")
    return g.select("arm", "cutoff", F.round(F.col("a") - F.col("b"), 6).alias("gain"))


@query(
    using("bars_m")
    + """, g as (select sym, day, close / lag(close) over (partition by sym order by day) - 1 as r from bars_m), w as (select sym, day, r, case when r is null then 0 else -sign(r) * least(abs(r), 0.5) end as w from g), b as (select sym, day, r, sum(w) over (partition by sym order by day rows between 3 preceding and 1 preceding) / 3 as book from w)
select day, round(avg(book * r), 9) as pnl, round(sum(abs(book)), 6) as gross from b where r is not null and book is not null group by day"""
)
def overlapping_book(spark: SparkSession, folder: str) -> DataFrame:
    """The return of a book that averages the weights of the last three months."""
    x = bars_m(spark, folder).select("sym", "day", back("close", 1, by_sym()).alias("r"))
    x = x.withColumn("w", F.when(F.col("r").isNull(), 0.0).otherwise(-F.signum("r") * F.least(F.abs("r"), F.lit(0.5))))
    x = x.select("day", "r", (F.sum("w").over(by_sym().rowsBetween(-3, -1)) / 3).alias("book")).where("r is not null and book is not null")
    return x.groupBy("day").agg(F.round(F.avg(F.col("book") * F.col("r")), 9).alias("pnl"), F.round(F.sum(F.abs("book")), 6).alias("gross"))


@query(
    """with d as (select distinct seq, cohort, ticker, logodds from ledger where type = 'decision' and isfinite(logodds)), b as (select cohort, count(*) as n, avg(logodds) as m, max(logodds) as hi from d group by 1), p as (select cohort, [struct_pack(name := 'n', v := cast(n as double)), struct_pack(name := 'mean', v := m), struct_pack(name := 'high', v := hi)] as books from b)
select cohort, u.name as name, round(u.v, 11) + 0.0 as v from (select cohort, unnest(books) as u from p)"""
)
def flattened_books(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of named figures, one for each cohort, as rows."""
    d = table(spark, folder, "ledger").where("type = 'decision' and logodds is not null and not isnan(logodds) and abs(logodds) < double('inf')").select("seq", "cohort", "ticker", "logodds").distinct()
    b = d.groupBy("cohort").agg(F.create_map(F.lit("n"), F.count("*").cast("double"), F.lit("mean"), F.avg("logodds"), F.lit("high"), F.max("logodds")).alias("books"))
    return b.select("cohort", F.explode("books").alias("name", "v")).select("cohort", "name", (F.round("v", 11) + 0.0).alias("v"))



def _start(seed: str, draw: str, block: str, room: str) -> str:
    return f"cast('0x' || left(md5({seed} || '|' || {draw} || '|' || {block}), 8) as bigint) % ({room})"


@query(
    using("preds") + _RANKED
    + f""", s as (select arm, ic, row_number() over (partition by arm order by cutoff) - 1 as i, count(*) over (partition by arm) as n from ic),
d as (select s.arm, t.d, ({_start("0", "t.d", "(s.i // least(3, s.n))", "s.n")} + s.i % least(3, s.n)) % s.n as j from s, range(2000) t(d) where s.n > 1), m as (select d.arm, d.d, avg(s.ic) as m from d join s on s.arm = d.arm and s.i = d.j group by 1, 2),
q as (select arm, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by arm)
select arm, count(*) as n, round(avg(ic), 6) + 0.0 as estimate, round(any_value(lo), 6) + 0.0 as lo, round(any_value(hi), 6) + 0.0 as hi from s left join q using (arm) group by arm"""
)
def bootstrap_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """95 % intervals of each arm's mean rank correlation, from 2,000 draws of circular blocks of three months."""
    x = interval(_ics(spark, folder), ["arm"], ["cutoff"], ["ic"], {"mean": mean("ic")}, block=3)
    return x.select("arm", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("estimate", "lo", "hi")])


_STATISTICS = {"excess": difference("r", "rm"), "sharpe": mean_to_deviation("r", 12.0), "beta": slope("r", "rm"), "alpha": intercept("r", "rm")}
_SECTORS = """, n as (select s_suppkey as sym, n_regionkey as sector from supplier join nation on n_nationkey = s_nationkey), c as (select day, avg(close) as mc from bars_m group by day), k as (select sector, day, avg(close) as sc from bars_m join n using (sym) group by 1, 2),
g as (select sector, day, sc / lag(sc) over (partition by sector order by day) - 1 as r, mc / lag(mc) over (partition by sector order by day) - 1 as rm from k join c using (day)), s as (select *, row_number() over (partition by sector order by day) - 1 as i, count(*) over (partition by sector) as n from g where r is not null)"""
_OF_ROWS = "avg(r) - avg(rm) as excess, avg(r) / stddev_samp(r) * sqrt(12) as sharpe, regr_slope(r, rm) as beta, regr_intercept(r, rm) as alpha"


@query(
    using("bars_m") + _SECTORS
    + f""", d as (select s.sector, t.d, ({_start("1", "t.d", "(s.i // least(5, s.n))", "s.n - least(5, s.n) + 1")} + s.i % least(5, s.n)) % s.n as j from s, range(500) t(d) where s.n > 1), m as (select d.sector, d.d, {_OF_ROWS} from d join s on s.sector = d.sector and s.i = d.j group by 1, 2),
l as (unpivot m on excess, sharpe, beta, alpha into name statistic value v), q as (select sector, statistic, quantile_cont(v, 0.1) as lo, quantile_cont(v, 0.9) as hi from l group by 1, 2), e as (select sector, count(*) as n, {_OF_ROWS} from s group by 1), k2 as (unpivot e on excess, sharpe, beta, alpha into name statistic value estimate)
select cast(sector as bigint) as sector, statistic, n, round(estimate, 6) + 0.0 as estimate, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi from k2 left join q using (sector, statistic)"""
)
def benchmark_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """80 % intervals of each sector's excess over the market, yearly Sharpe ratio, beta and alpha: months are drawn in blocks of five that fit, both series together."""
    n = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    d = table(spark, folder, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").cast("bigint").alias("sector"))  # 25 nations
    b = bars_m(spark, folder)
    k = b.join(d, "sym").groupBy("sector", "day").agg(F.avg("close").alias("sc")).join(b.groupBy("day").agg(F.avg("close").alias("mc")), "day")
    w = W.partitionBy("sector").orderBy("day")
    x = k.select("sector", "day", back("sc", 1, w).alias("r"), back("mc", 1, w).alias("rm"))
    y = interval(x, ["sector"], ["day"], ["rm", "r"], _STATISTICS, draws=500, block=5, seed=1, circular=False, inside=0.8)
    return y.select("sector", "statistic", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("estimate", "lo", "hi")])


@query(
    using("px_d")
    + f""", r as (select day, close / lag(close) over (order by day) - 1 as r from px_d), s as (select r, row_number() over (order by day) - 1 as i, count(*) over () as n from r where r is not null), c as (select any_value(n) as n from s),
p as (select t.p, k.i, {_start("0", "t.p", "(k.i // least(21, c.n))", "c.n - least(21, c.n) + 1")} + k.i % least(21, c.n) as j from c, range(4000) t(p), range(252) k(i)), w as (select p, p.i, sum(ln(1 + r)) over (partition by p order by p.i) as g from p join s on s.i = p.j % c_n(p.p) ),
m as (select p, i, g, greatest(0, max(g) over (partition by p order by i)) as top from w), e as (select p, exp(last(g order by i)) as final, least(0, min(exp(g - top) - 1)) as worst from m group by p)
select count(*) as n, round(quantile_cont(final, 0.05), 6) as p5, round(quantile_cont(final, 0.5), 6) as p50, round(quantile_cont(final, 0.95), 6) as p95, round(avg(case when worst <= -0.2 then 1.0 else 0.0 end), 6) as fall from e""".replace("p.j % c_n(p.p) ", "p.j")
)
def path_odds(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of a year's growth and the odds of falling by a fifth, over 4,000 paths of 21-day blocks of the index's returns."""
    paths = path_cone(px_d(spark, folder).select("day", back("close", 1, by_day()).alias("r")), ["day"], "r", 252, 4000, 21)
    return paths.agg(F.count("*").alias("n"), *[F.round(F.percentile("final", q / 100), 6).alias(f"p{q}") for q in (5, 50, 95)], F.round(F.avg((F.col("worst") <= -0.2).cast("double")), 6).alias("fall"))


@query(
    using("preds")
    + f""", x as (select arm, cutoff, run_id, p, ret, count(*) over (partition by arm, cutoff) as n from preds), y as (select arm, cutoff, run_id, {_r('p')} as rp, {_r('ret')} as rr from x where n >= 10), real as (select arm, avg(ic) as real from (select arm, cutoff, case when stddev_pop(rp) > 0 and stddev_pop(rr) > 0 then corr(rp, rr) end as ic from y group by 1, 2) group by 1),
z as (select arm, cutoff, seed, rr, row_number() over (partition by arm, cutoff, seed order by md5(seed || '|' || run_id), run_id) as rs from y, range(50) t(seed)), m as (select arm, seed, avg(ic) as ic from (select arm, cutoff, seed, case when stddev_pop(rr) > 0 then corr(rs, rr) end as ic from z group by 1, 2, 3) group by 1, 2)
select arm, round(any_value(real), 6) as real, count(*) as seeds, (count(*) filter (where ic >= real) + 1) / (count(*) + 1) as p from m join real using (arm) group by arm"""
)
def permutation_control(spark: SparkSession, folder: str) -> DataFrame:
    """How often shuffled forecasts reach the true mean rank correlation: 50 orders, each by a hash of seed and row, ranked within arm and month."""
    x = preds(spark, folder).select("arm", "cutoff", "run_id", "p", "ret", F.count("*").over(W.partitionBy("arm", "cutoff")).alias("n")).where("n >= 10")
    x = x.select("arm", "cutoff", "run_id", average_rank("p", "arm", "cutoff").alias("rp"), average_rank("ret", "arm", "cutoff").alias("rr"))
    real = x.groupBy("arm", "cutoff").agg(correlation("rp", "rr").alias("ic")).groupBy("arm").agg(F.avg("ic").alias("real"))
    s = x.select("arm", "cutoff", "run_id", "rr", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("seed")).withColumn("at", F.md5(F.concat_ws("|", F.col("seed").cast("string"), "run_id").cast("binary")))
    s = s.withColumn("rs", F.row_number().over(W.partitionBy("arm", "cutoff", "seed").orderBy("at", "run_id")).cast("double"))
    m = s.groupBy("arm", "seed", "cutoff").agg(correlation("rs", "rr").alias("ic")).groupBy("arm", "seed").agg(F.avg("ic").alias("ic"))
    return m.join(real, "arm").groupBy("arm", "real").agg(F.sum((F.col("ic") >= F.col("real")).cast("int")).alias("reached"), F.count("*").alias("seeds")).select("arm", F.round("real", 6).alias("real"), "seeds", ((F.col("reached") + 1) / (F.col("seeds") + 1)).alias("p"))


#: Months in which pairs are formed, and the deviations of a pair's spread in those months beyond which it is traded.
FORMED, BEYOND, COST = 36, 2.0, 0.001


@query(
    using("bars_m")
    + f""", s as (select b.*, n_regionkey as sector, row_number() over (order by null) as z from bars_m b join supplier on s_suppkey = sym join nation on n_nationkey = s_nationkey), edge as (select min(day) + interval {FORMED} months as e from bars_m),
f as (select sym, sector, day, close, day < e as old, first_value(close) over (partition by sym order by day) as c0 from s, edge), g as (select sym, sector, day, close, close / c0 as g, old from f), k as (select sym from g where old group by sym having count(*) >= 24),
p as (select a.sector, a.sym as a, b.sym as b, sum((a.g - b.g) * (a.g - b.g)) as ssd, stddev_samp(a.g - b.g) as sd from g a join g b on a.sector = b.sector and a.day = b.day and a.sym < b.sym where a.old and b.old and a.sym in (select sym from k) and b.sym in (select sym from k) group by 1, 2, 3 having count(*) >= 24 qualify row_number() over (partition by a.sector order by sum((a.g - b.g) * (a.g - b.g)), a.sym, b.sym) <= 5),
x as (select p.a, p.b, ga.day, (ga.g - gb.g) / sd as z, ga.close as ca, gb.close as cb from p join g ga on ga.sym = p.a join g gb on gb.sym = p.b and gb.day = ga.day where not ga.old and sd > 0),
y as (select *, ca / lag(ca) over w - cb / lag(cb) over w as move, sign(z) <> lag(sign(z)) over w as crossed from x window w as (partition by a, b order by day)),
c as (select *, count(*) filter (where crossed) over (partition by a, b order by day) as stretch from y), o as (select *, min(day) filter (where abs(z) > {BEYOND}) over (partition by a, b, stretch) as opened, max(sign(z)) over (partition by a, b, stretch) as side from c),
h as (select *, coalesce(lag(opened is not null and day > opened) over w, false) as was, coalesce(lag(opened is not null and day >= opened) over w, false) as due, lag(side) over w as before from o window w as (partition by a, b order by day)),
t as (select a, b, day, z, case when was then -before * move else 0 end as gain, was, due from h), v as (select *, due <> coalesce(lag(due) over (partition by a, b order by day), false) as turned from t)
select cast(a as bigint) as a, cast(b as bigint) as b, day, round(z, 6) as z, round(gain - case when turned then 2 * {COST} else 0 end, 8) + 0.0 as pnl from v"""
)
def pair_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Profit and loss by month of the five closest pairs of each sector, formed on the first FORMED months and traded after them.

    A stretch lies between two crossings of the pair's normalised prices. The first month of a stretch in which the spread is beyond BEYOND deviations of the
    formation opens the pair, short the dearer side, at the next month's close; the month that crosses closes it at its close. Opening and closing cost two
    legs each. No state is carried: stretches are numbered by a running count of crossings, and what is held follows from the month before.
    """
    n = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    d = table(spark, folder, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").cast("bigint").alias("sector"))  # 25 nations
    bars = bars_m(spark, folder)
    first = bars.agg(F.min("day")).first()[0]  # one day
    edge = F.add_months(F.lit(first).cast("date"), FORMED)
    g = bars.join(d, "sym").select("sym", "sector", "day", "close", (F.col("close") / F.first("close").over(by_sym())).alias("g"), (F.col("day") < edge).alias("old"))
    pairs = closest_pairs(g.where("old"), "sector", "sym", "day", "g", 5, 24).where("sd > 0")
    later = g.where("not old").select("sym", "day", "close", "g")
    side = lambda c: later.select(F.col("sym").alias(c), "day", F.col("close").alias(f"c{c}"), F.col("g").alias(f"g{c}"))
    x = pairs.select("a", "b", "sd").join(side("a"), "a").join(side("b"), ["b", "day"]).withColumn("z", (F.col("ga") - F.col("gb")) / F.col("sd"))
    w = W.partitionBy("a", "b").orderBy("day")
    sign = F.signum("z")
    x = x.select("a", "b", "day", "z", (back("ca", 1, w) - back("cb", 1, w)).alias("move"), F.coalesce(sign != F.lag(sign).over(w), F.lit(False)).cast("int").alias("crossed"), sign.alias("sign"))
    x = x.withColumn("stretch", F.sum("crossed").over(w))
    own = W.partitionBy("a", "b", "stretch")
    x = x.withColumn("opened", F.min(F.when(F.abs("z") > BEYOND, F.col("day"))).over(own)).withColumn("side", F.max("sign").over(own))
    lag = lambda c: F.coalesce(F.lag(F.coalesce(c, F.lit(False))).over(w), F.lit(False))
    x = x.select("*", lag(F.col("day") > F.col("opened")).alias("was"), lag(F.col("day") >= F.col("opened")).alias("due"), F.lag("side").over(w).alias("before"))
    cost = F.when(F.col("due") != F.coalesce(F.lag("due").over(w), F.lit(False)), 2 * COST).otherwise(0.0)
    return x.select("a", "b", "day", F.round("z", 6).alias("z"), (F.round(F.when(F.col("was"), -F.col("before") * F.col("move")).otherwise(0.0) - cost, 8) + 0.0).alias("pnl"))


@query(
    "with r as (select distinct claim_id, made_by, verification_status, is_numeric from claims) select made_by, count(*) as n, round(avg(case when is_numeric then 1.0 else 0.0 end), 6) as numeric_share, round(avg(case when verification_status = 'verified' then 1.0 else 0.0 end) filter (where is_numeric), 6) as numeric_pass, first(verification_status order by verification_status) as first_status from r group by 1"
)
def authors(spark: SparkSession, folder: str) -> DataFrame:
    """By author the share of numeric claims and how many of those passed."""
    r = table(spark, folder, "claims").select("claim_id", "made_by", "verification_status", "is_numeric").distinct()
    passed = F.coalesce(F.col("verification_status") == "verified", F.lit(False)).cast("double")
    numeric = F.coalesce("is_numeric", F.lit(False))
    return r.groupBy("made_by").agg(F.count("*").alias("n"), F.round(F.avg(numeric.cast("double")), 6).alias("numeric_share"), F.round(F.avg(F.when(numeric, passed)), 6).alias("numeric_pass"), F.min("verification_status").alias("first_status"))


def tree_values(strike: pd.Series, deviation: pd.Series, spot: float, rate: float, years: float, steps: int) -> pd.Series:
    """Puts that may be exercised early, on a binomial tree: the whole column is rolled back at once, step by step, over an array of nodes by options."""
    k, up = strike.to_numpy(float), np.exp(deviation.to_numpy(float) * math.sqrt(years / steps))
    grow, hold = math.exp(rate * years / steps), math.exp(-rate * years / steps)
    with np.errstate(all="ignore"):
        q = (grow - 1 / up) / (up - 1 / up)
        price = lambda n: spot * up ** (2.0 * np.arange(n + 1)[:, None] - n)
        value = np.maximum(k - price(steps), 0.0)
        for n in range(steps - 1, -1, -1):
            value = np.maximum(hold * (q * value[1:] + (1 - q) * value[:-1]), k - price(n))
    return pd.Series(value[0])


@query(
    """with recursive o as (select distinct 80.0::double + c_custkey % 41 as k, 0.1::double + (c_custkey % 7) * 0.05::double as v from customer), u as (select k, v, exp(v * sqrt(0.5::double / 50)) as u from o), q as (select *, (exp(0.03::double * 0.5 / 50) - 1 / u) / (u - 1 / u) as q from u),
t as (select k, v, u, q, 50 as n, [greatest(k - 100 * pow(u, 2.0 * i - 50), 0) for i in range(0, 51)] as x from q
  union all select k, v, u, q, n - 1, [greatest(exp(-0.03::double * 0.5 / 50) * (q * x[i + 2] + (1 - q) * x[i + 1]), k - 100 * pow(u, 2.0 * i - (n - 1))) for i in range(0, n)] from t where n > 0)
select c.c_custkey, round(t.x[1], 4) as put from customer c join t on t.n = 0 and t.k = 80.0::double + c.c_custkey % 41 and t.v = 0.1::double + (c.c_custkey % 7) * 0.05::double"""
)
def tree_price(spark: SparkSession, folder: str) -> DataFrame:
    """Puts that may be exercised early, priced on a binomial tree of 50 steps, a batch of options at a time."""
    @F.pandas_udf("double")
    def put(k: pd.Series, v: pd.Series) -> pd.Series:
        return tree_values(k, v, 100.0, 0.03, 0.5, 50)

    x = table(spark, folder, "customer").select("c_custkey", (80.0 + F.pmod("c_custkey", F.lit(41))).alias("k"), (0.1 + F.pmod("c_custkey", F.lit(7)) * 0.05).alias("v"))
    return x.select("c_custkey", F.round(put("k", "v"), 4).alias("put"))


@query(
    """with e as (select event_id, case when event_id % 3 = 0 then null else -0.1 - value / 50 end as up, case when event_id % 5 = 0 then null else -0.5 - (event_id % 7) / 3.0 end as down, -6.0 as other from events), f as (select *, least(up, down, other) as floor from e)
select event_id, case when up is null and down is null then 0.0 else round(coalesce(up, floor) - coalesce(down, floor), 6) end as odds, up is null or down is null as censored from f"""
)
def censored_odds(spark: SparkSession, folder: str) -> DataFrame:
    """Log odds of two words where one may be missing among the candidates: it then has the least log probability listed, and the odds are marked."""
    e = table(spark, folder, "events").select("event_id", "value")
    up = F.when(F.pmod("event_id", F.lit(3)) != 0, -0.1 - F.col("value") / 50)
    down = F.when(F.pmod("event_id", F.lit(5)) != 0, -0.5 - F.pmod("event_id", F.lit(7)) / 3.0)
    e = e.select("event_id", F.filter(F.array(F.struct(F.lit("UP").alias("t"), up.alias("l")), F.struct(F.lit("DOWN").alias("t"), down.alias("l")), F.struct(F.lit("MAYBE").alias("t"), F.lit(-6.0).alias("l"))), lambda x: x["l"].isNotNull()).alias("c"))
    found = lambda w: F.try_element_at(F.filter("c", lambda x: x["t"] == w), F.lit(1))["l"]
    x = e.select("event_id", found("UP").alias("up"), found("DOWN").alias("down"), F.array_min(F.transform("c", lambda x: x["l"])).alias("floor"))
    both = F.col("up").isNull() & F.col("down").isNull()
    return x.select("event_id", F.when(both, 0.0).otherwise(F.round(F.coalesce("up", "floor") - F.coalesce("down", "floor"), 6)).alias("odds"), (F.col("up").isNull() | F.col("down").isNull()).alias("censored"))


@query(
    r"""with d as (select doc_id, unnest(list_distinct(regexp_extract_all(text, 'Q[1-4] (?:19|20)[0-9]{2}'))) as t from documents where text is not null) select doc_id, last_day(make_date(cast(right(t, 4) as int), 3 * cast(substring(t, 2, 1) as int), 1)) as day from d"""
)
def dates_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct quarters that each whole text names, by their last days."""
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("Q[1-4] (?:19|20)[0-9]{2}"), F.lit(0)))).alias("t"))
    return x.select("doc_id", F.last_day(F.make_date(F.right("t", F.lit(4)).cast("int"), 3 * F.substring("t", 2, 1).cast("int"), F.lit(1))).alias("day"))

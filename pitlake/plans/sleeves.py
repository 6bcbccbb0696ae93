"""Portfolios of series: trend and carry sleeves, capped allocations, contributions to risk, two-asset weights and simulated prices.

A portfolio's variance, w'Sw, is never worked out from a matrix: it is the variance of what the weights would have returned in the months behind S, one sum
for each month, so that names need not meet names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import _A, _B, _C, _D, back, div, normal_ppf
from pitlake.operators.books import paper_books, sessions_of
from pitlake.operators.resampling import place
from pitlake.plans.registry import query
from pitlake.plans.views import bars_m, using
from pitlake.plans.windows import by_sym
from pitlake.sources.tables import table

#: Months behind a covariance, the yearly deviation aimed at, and the greatest sum of absolute weights.
MONTHS, TARGET, GROSS, FINANCING = 24, 0.10, 2.0, 0.03

_N = """with n as (select s_nationkey as name, cast(date_trunc('month', l_shipdate) as date) as day, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(l_quantity) as double) as px from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
r as (select name, day, px, px / lag(px) over w - 1 as r, px / lag(px, 12) over w - 1 as mom, stddev_samp(px / px0 - 1) over (partition by name order by day rows between 23 preceding and current row) as vol, count(px0) over (partition by name order by day rows between 23 preceding and current row) as k, lead(px) over w / px - 1 as nxt from (select *, lag(px) over (partition by name order by day) as px0 from n) window w as (partition by name order by day))"""


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """name, day, r, mom, vol (of MONTHS returns, k of them known), nxt: the nations' monthly prices and what follows from them."""
    s = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("name"))
    x = table(spark, folder, "lineitem").select("l_suppkey", F.trunc("l_shipdate", "month").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.groupBy("name", "day").agg((F.sum("v").cast("double") / F.sum("l_quantity").cast("double")).alias("px"))
    w = W.partitionBy("name").orderBy("day")
    f = w.rowsBetween(1 - MONTHS, 0)
    x = x.select("name", "day", back("px", 1, w).alias("r"), back("px", 12, w).alias("mom"), (F.lead("px").over(w) / F.col("px") - 1).alias("nxt"))
    return x.select("*", F.stddev_samp("r").over(f).alias("vol"), F.count("r").over(f).alias("k"))


def past_deviation(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(day, deviation) of what the weights of each day would have returned in the MONTHS months up to it: the square root of w'Sw. weights: name, day, w."""
    w = weights.select("name", F.col("day").alias("_at"), "w", F.explode(F.sequence(F.add_months("day", 1 - MONTHS), F.col("day"), F.expr("interval 1 month"))).alias("day"))
    month = w.join(returns.select("name", "day", "r").where("r is not null"), ["name", "day"]).groupBy("_at", "day").agg(F.sum(F.col("w") * F.col("r")).alias("p"))
    return month.groupBy(F.col("_at").alias("day")).agg(F.stddev_samp("p").alias("deviation"))


@query(
    _N + f""", w as (select name, day, sign(mom) / vol as w, nxt from r where k = {MONTHS} and mom is not null and vol > 0), h as (select w.day as at_, r.day, sum(w.w * r.r) as p from w join r on r.name = w.name and r.day <= w.day and r.day > w.day - interval {MONTHS} months where r.r is not null group by 1, 2),
d as (select at_ as day, stddev_samp(p) as s from h group by 1), g as (select day, count(*) as names, sum(abs(w)) as gross, sum(w * nxt) as raw from w group by 1), c as (select g.*, least({TARGET / math.sqrt(12)!r} / s, {GROSS} / gross) as scale from g join d using (day))
select day, names, round(scale * gross, 6) as gross, round(scale * raw - greatest(scale * gross - 1, 0) * {FINANCING} / 12, 8) as ret from c"""
)
def trend_sleeve(spark: SparkSession, folder: str) -> DataFrame:
    """A trend portfolio's months: the sign of a year's change over the deviation, scaled to a deviation aimed at before the event, within a gross cap, borrowed money paid for."""
    x = _names(spark, folder)
    w = x.where(f"k = {MONTHS} and mom is not null and vol > 0").select("name", "day", (F.signum("mom") / F.col("vol")).alias("w"), "nxt")
    g = w.groupBy("day").agg(F.count("*").alias("names"), F.sum(F.abs("w")).alias("gross"), F.sum(F.col("w") * F.col("nxt")).alias("raw"))
    c = g.join(past_deviation(w, x), "day").withColumn("scale", F.least(TARGET / math.sqrt(12) / F.col("deviation"), GROSS / F.col("gross")))
    gross = F.col("scale") * F.col("gross")
    return c.select("day", "names", F.round(gross, 6).alias("gross"), F.round(F.col("scale") * F.col("raw") - F.greatest(gross - 1, F.lit(0.0)) * FINANCING / 12, 8).alias("ret"))


@query(
    _N + """, c as (select name, day, lag(mom) over (partition by name order by day) as carry, nxt from r), k as (select *, row_number() over (partition by day order by carry desc, name) as hi, row_number() over (partition by day order by carry, name) as lo, count(*) over (partition by day) as n from c where carry is not null and nxt is not null)
select day, round(avg(nxt) filter (where hi <= 3) - avg(nxt) filter (where lo <= 3), 8) as ret, list_sort(list(name) filter (where hi <= 3)) as long, list_sort(list(name) filter (where lo <= 3)) as short from k where n >= 6 group by day"""
)
def carry_sleeve(spark: SparkSession, folder: str) -> DataFrame:
    """By month the three names with the highest figure known a month before against the three with the lowest."""
    x = _names(spark, folder)
    x = x.select("name", "day", F.lag("mom").over(W.partitionBy("name").orderBy("day")).alias("carry"), "nxt").where("carry is not null and nxt is not null")
    day = W.partitionBy("day")
    k = x.select("*", F.row_number().over(day.orderBy(F.desc("carry"), "name")).alias("hi"), F.row_number().over(day.orderBy("carry", "name")).alias("lo"), F.count("*").over(day).alias("n")).where("n >= 6 and (hi <= 3 or lo <= 3)")
    of = lambda c, v: F.when(F.col(c) <= 3, F.col(v))
    return k.groupBy("day").agg(F.round(F.avg(of("hi", "nxt")) - F.avg(of("lo", "nxt")), 8).alias("ret"), F.sort_array(F.collect_list(of("hi", "name"))).alias("long"), F.sort_array(F.collect_list(of("lo", "name"))).alias("short"))


#: Greatest weight of a name, of a sector, and of all names together.
NAME, SECTOR, ALL = 0.02, 0.25, 0.9


@query(
    using("bars_m")
    + f""", n as (select s_suppkey as sym, n_regionkey as sector from supplier join nation on n_nationkey = s_nationkey), r as (select sym, day, close / lag(close) over (partition by sym order by day) - 1 as r from bars_m), e as (select *, avg(r) over w as m, var_samp(r) over w as v, count(r) over w as k from r window w as (partition by sym order by day rows between 23 preceding and current row)),
a as (select e.sym, n.sector, day, least(greatest(0.5 * m / v, 0), {NAME}) as w from e join n using (sym) where k >= 12 and v > 0), b as (select *, w * least(1, {SECTOR} / nullif(sum(w) over (partition by day, sector), 0)) as w1 from a), c as (select *, w1 * least(1, {ALL} / nullif(sum(w1) over (partition by day), 0)) as w2 from b where w1 > 0)
select sym, day, round(w2, 8) as weight, round(1 - sum(w2) over (partition by day), 6) as core from c"""
)
def capped_allocation(spark: SparkSession, folder: str) -> DataFrame:
    """Half the growth-optimal weight of each name by its last 24 months, cut to caps by name, sector and in all; the rest stays in the core. Caps are windows, no loop."""
    d = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").alias("sector"))  # 25 nations
    f = by_sym().rowsBetween(-23, 0)
    x = bars_m(spark, folder).select("sym", "day", back("close", 1, by_sym()).alias("r")).select("sym", "day", F.avg("r").over(f).alias("m"), F.var_samp("r").over(f).alias("v"), F.count("r").over(f).alias("k")).where("k >= 12 and v > 0")
    x = x.join(d, "sym").select("sym", "sector", "day", F.least(F.greatest(0.5 * F.col("m") / F.col("v"), F.lit(0.0)), F.lit(NAME)).alias("w"))
    within = lambda cap, w: F.col("w") * F.least(F.lit(1.0), div(F.lit(cap), F.sum("w").over(w)))
    x = x.withColumn("w", within(SECTOR, W.partitionBy("day", "sector"))).where("w > 0").withColumn("w", within(ALL, W.partitionBy("day")))
    return x.select("sym", "day", F.round("w", 8).alias("weight"), F.round(1 - F.sum("w").over(W.partitionBy("day")), 6).alias("core"))


@query(
    _N + f""", w as (select name, day as at_, (1 / vol) / sum(1 / vol) over (partition by day) as w from r where k = {MONTHS} and vol > 0), h as (select w.at_, w.name, w.w, r.day, w.w * r.r as c, sum(w.w * r.r) over (partition by w.at_, r.day) as p from w join r on r.name = w.name and r.day <= w.at_ and r.day > w.at_ - interval {MONTHS} months where r.r is not null),
s as (select at_, name, any_value(w) as w, covar_samp(c, p) / var_samp(p) as share, stddev_samp(c) as own, stddev_samp(p) as total from h group by 1, 2)
select at_ as day, name, round(w, 8) as weight, round(share, 8) as share, round(1 / sum(share * share) over (partition by at_), 6) as bets, round(sum(own) over (partition by at_) / total, 6) as diversification from s"""
)
def risk_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """Each name's share of the variance of a portfolio weighted by inverse deviations, how many equal bets that comes to, and what spreading saves."""
    x = _names(spark, folder)
    w = x.where(f"k = {MONTHS} and vol > 0").select("name", "day", (1 / F.col("vol") / F.sum(1 / F.col("vol")).over(W.partitionBy("day"))).alias("w"))
    h = w.select("name", F.col("day").alias("at"), "w", F.explode(F.sequence(F.add_months("day", 1 - MONTHS), F.col("day"), F.expr("interval 1 month"))).alias("day"))
    h = h.join(x.select("name", "day", "r").where("r is not null"), ["name", "day"]).withColumn("c", F.col("w") * F.col("r")).withColumn("p", F.sum("c").over(W.partitionBy("at", "day")))
    s = h.groupBy("at", "name").agg(F.first("w").alias("w"), (F.covar_samp("c", "p") / F.var_samp("p")).alias("share"), F.stddev_samp("c").alias("own"), F.stddev_samp("p").alias("total"))
    at = W.partitionBy("at")
    return s.select(F.col("at").alias("day"), "name", F.round("w", 8).alias("weight"), F.round("share", 8).alias("share"), F.round(1 / F.sum(F.col("share") * F.col("share")).over(at), 6).alias("bets"), F.round(F.sum("own").over(at) / F.col("total"), 6).alias("diversification"))


@query(
    _N + """, p as (select a.name as a, b.name as b, count(*) as n, var_samp(a.r) as va, var_samp(b.r) as vb, covar_samp(a.r, b.r) as c, avg(a.r) as ma, avg(b.r) as mb from r a join r b on a.day = b.day and a.name < b.name where a.r is not null and b.r is not null group by 1, 2)
select a, b, n, round((vb - c) / (va + vb - 2 * c), 6) as least_variance, round(least(greatest((vb - c) / (va + vb - 2 * c), 0), 1), 6) as long_only, round((vb * ma - c * mb) / nullif(vb * ma - c * mb + va * mb - c * ma, 0), 4) as mean_variance from p where n > 2 and va + vb - 2 * c > 1e-12"""
)
def two_asset_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The first one's weight in every pair of nations: of least variance, the same without selling short, and of the best mean for its variance."""
    x = _names(spark, folder).where("r is not null")
    y = x.select(F.col("name").alias("b"), "day", F.col("r").alias("rb"))
    p = x.select(F.col("name").alias("a"), "day", F.col("r").alias("ra")).join(y, "day").where("a < b")  # 25 nations, as a matrix of all pairs is what is asked for
    p = p.groupBy("a", "b").agg(F.count("*").alias("n"), F.var_samp("ra").alias("va"), F.var_samp("rb").alias("vb"), F.covar_samp("ra", "rb").alias("c"), F.avg("ra").alias("ma"), F.avg("rb").alias("mb"))
    va, vb, c, ma, mb = (F.col(k) for k in ("va", "vb", "c", "ma", "mb"))
    p = p.where((F.col("n") > 2) & (va + vb - 2 * c > 1e-12)).withColumn("w", (vb - c) / (va + vb - 2 * c))
    return p.select("a", "b", "n", F.round("w", 6).alias("least_variance"), F.round(F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0)), 6).alias("long_only"), F.round(div(vb * ma - c * mb, vb * ma - c * mb + va * mb - c * ma), 4).alias("mean_variance"))


def _ppf_sql(p: str) -> str:
    def horner(of: tuple[float, ...], x: str) -> str:
        out = "0.0"
        for k in of:
            out = f"({out} * {x} + {k!r})"
        return out

    tail = lambda q: f"({horner(_C, q)} / ({horner(_D, q)} * {q} + 1))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"case when {p} < 0.02425 then {tail(low)} when {p} > 0.97575 then -{tail(high)} else {horner(_A, r)} * ({p} - 0.5) / ({horner(_B, r)} * {r} + 1) end"


PATHS = 400


@query(
    f"""with o as (select distinct c_custkey % 41 as i, c_custkey % 7 as j from customer), u as (select i, j, 80.0::double + i as k, 0.1::double + j * 0.05::double as v, (cast('0x' || left(md5('0|' || i || '|' || j || '|' || p), 8) as bigint) + 0.5) / 4294967296.0::double as u from o, range({PATHS}) t(p)),
z as (select *, {_ppf_sql('u')} as z from u), s as (select i, j, k, greatest(100 * exp((0.03 - v * v / 2) * 0.5 + v * sqrt(0.5) * z) - k, 0) as a, greatest(100 * exp((0.03 - v * v / 2) * 0.5 - v * sqrt(0.5) * z) - k, 0) as b from z),
m as (select i, j, exp(-0.015) * avg((a + b) / 2) as price, exp(-0.015) * stddev_samp((a + b) / 2) / sqrt({PATHS}) as error from s group by 1, 2) select c_custkey, round(price, 5) as price, round(error, 5) as error from customer join m on i = c_custkey % 41 and j = c_custkey % 7"""
)
def simulated_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by simulation: normal draws from hashes, each with its mirror image, the mean and its standard error; options of one strike and deviation are simulated once."""
    c = table(spark, folder, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(41)).alias("i"), F.pmod("c_custkey", F.lit(7)).alias("j"))
    o = c.select("i", "j").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(PATHS - 1))))
    u = (place(F.lit(1 << 32), F.lit(0), F.col("i"), F.col("j"), F.col("p")) + 0.5) / float(1 << 32)
    z = o.select("i", "j", (80.0 + F.col("i")).alias("k"), (0.1 + F.col("j") * 0.05).alias("v"), u.alias("u")).withColumn("z", normal_ppf(F.col("u")))
    end = lambda s: F.greatest(100 * F.exp((0.03 - F.col("v") * F.col("v") / 2) * 0.5 + s * F.col("v") * math.sqrt(0.5) * F.col("z")) - F.col("k"), F.lit(0.0))
    m = z.select("i", "j", ((end(1) + end(-1)) / 2).alias("x")).groupBy("i", "j").agg((math.exp(-0.015) * F.avg("x")).alias("price"), (math.exp(-0.015) * F.stddev_samp("x") / math.sqrt(PATHS)).alias("error"))
    return c.join(m, ["i", "j"]).select("c_custkey", F.round("price", 5).alias("price"), F.round("error", 5).alias("error"))


#: Names that a book holds.
PLACES = 5


@query(
    using("bars_m", recursive=True)
    + f""", n as (select s_suppkey as sym, n_regionkey as sector from supplier join nation on n_nationkey = s_nationkey), m as (select b.sym, n.sector, b.day, b.open, b.close, b.close / lag(b.close, 3) over (partition by b.sym order by b.day) - 1 as mom from bars_m b join n using (sym)),
d as (select sector, day, lead(day) over (partition by sector order by day) as nxt from (select distinct sector, day from m)), k as (select m.sector, d.nxt as day, m.sym, row_number() over (partition by m.sector, m.day order by m.mom desc, m.sym) as place from m join d using (sector, day) where m.mom is not null and d.nxt is not null),
t as (select k.*, b.open, b.close from k left join bars_m b on b.day = k.day and b.sym = k.sym where place <= {PLACES}), s as (select sector, day, lead(day) over (partition by sector order by day) as nxt, row_number() over (partition by sector order by day) as i from (select distinct sector, day from t)),
p as (select t.sector, s.nxt as day, t.sym, t.place as was, coalesce(b.open, t.close, 0) as price from t join s using (sector, day) left join bars_m b on b.day = s.nxt and b.sym = t.sym where s.nxt is not null),
a as (select t.sector, t.day, list({{'o': t.open, 'c': t.close, 'b': p.was}} order by t.place) as new from t left join p on p.sector = t.sector and p.day = t.day and p.sym = t.sym group by 1, 2), o as (select p.sector, p.day, list({{'p': p.price, 's': t.sym is not null}} order by p.was) as old from p left join t on t.sector = p.sector and t.day = p.day and t.sym = p.sym group by 1, 2),
r as (select s.sector, s.day, s.i, a.new, coalesce(o.old, []) as old from s join a using (sector, day) left join o using (sector, day)),
f as (select sector, 0::bigint as i, cast(null as date) as day, 100000.0::double as cash, 100000.0::double as equity, 100000.0::double as peak, false as halted, 0.0::double as traded, [0.0::double, 0, 0, 0, 0] as h from (select distinct sector from r)
  union all select y.sector, y.i, y.day, y.cash, z.equity, greatest(y.peak, z.equity), y.halted or z.equity <= greatest(y.peak, z.equity) * 0.7, y.traded, y.n from (
    select x.*, x.there - list_sum([coalesce(x.n[j] * x.new[j].o, 0) + 0.0005 * coalesce(abs(x.n[j] - coalesce(x.h[x.new[j].b], 0)) * coalesce(x.new[j].o, x.old[x.new[j].b].p), 0) for j in range(1, len(x.new) + 1)]) as cash,
      x.leaving + list_sum([coalesce(abs(x.n[j] - coalesce(x.h[x.new[j].b], 0)) * coalesce(x.new[j].o, x.old[x.new[j].b].p), 0) for j in range(1, len(x.new) + 1)]) as traded
    from (select w.*, [case when w.halted or v.o is null or v.o <= 0 then 0.0::double else floor(w.there / {PLACES} / (v.o * 1.0005)) end for v in w.new] as n from (
      select r.sector, r.i, r.day, r.new, r.old, f.halted, f.peak, f.h, coalesce(list_sum([case when r.old[j].s then 0 else f.h[j] * r.old[j].p end for j in range(1, len(r.old) + 1)]), 0) as leaving,
        f.cash + coalesce(list_sum([f.h[j] * r.old[j].p for j in range(1, len(r.old) + 1)]), 0) - 0.0005 * coalesce(list_sum([case when r.old[j].s then 0 else f.h[j] * r.old[j].p end for j in range(1, len(r.old) + 1)]), 0) as there
      from f join r on r.sector = f.sector and r.i = f.i + 1) w) x) y, lateral (select y.cash + list_sum([coalesce(y.n[j] * y.new[j].c, 0) for j in range(1, len(y.new) + 1)]) as equity) z)
select cast(sector as bigint) as key, day, round(log10(equity), 7) as size, round(cash / equity, 6) + 0.0 as cash_share, cast(list_sum(h) as bigint) as shares, round(traded / equity, 6) as turnover, halted from f where i > 0"""
)
def paper_trading(spark: SparkSession, folder: str) -> DataFrame:
    """A book for each sector of the five names that rose most over three months, bought in whole shares at the next month's open, sells first, halted in a deep fall.

    size is the decimal logarithm of the book's worth; cash and what was traded are parts of it.
    """
    d = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").cast("bigint").alias("sector"))  # 25 nations
    b = bars_m(spark, folder).select("sym", "day", "open", "close")
    m = b.join(d, "sym").select("sym", "sector", "day", back("close", 3, by_sym()).alias("mom"))
    days = m.select("sector", "day").distinct().withColumn("next", F.lead("day").over(W.partitionBy("sector").orderBy("day")))
    k = m.where("mom is not null").withColumn("place", F.row_number().over(W.partitionBy("sector", "day").orderBy(F.desc("mom"), "sym"))).where(F.col("place") <= PLACES)
    k = k.join(days, ["sector", "day"]).where("next is not null").select("sector", F.col("next").alias("day"), "sym", "place")
    x = paper_books(sessions_of(k, b, "sector", "day", "sym", "place"), "bigint", places=PLACES)
    return x.select("key", "day", F.round(F.log10("equity"), 7).alias("size"), (F.round(F.col("cash") / F.col("equity"), 6) + 0.0).alias("cash_share"), "shares", F.round(F.col("traded") / F.col("equity"), 6).alias("turnover"), "halted")


@query(
    using("bars_m")
    + """, x as (select sym, day, lag(close) over w / nullif(lag(close, 12) over w, 0) - 1 as mom, lead(close) over w / close - 1 as nxt from bars_m window w as (partition by sym order by day)),
k as (select *, row_number() over (partition by day order by mom, sym) as i, count(*) over (partition by day) as n from x where mom is not null), q as (select sym, day, nxt, n, case when i > n - n // 5 then 1.0::double when i <= n // 5 then -1.0::double else 0 end / greatest(n // 5, 1) as w from k where n >= 20),
s as (select day, any_value(n) as n, sum(w * nxt) as raw from q group by day), v as (select *, stddev_samp(raw) over h as dev, count(raw) over h as months from s window h as (order by day rows between 12 preceding and 1 preceding)),
c as (select *, least(0.1 / nullif(dev * sqrt(12), 0), 2) as scale from v where months >= 6), t as (select q.sym, q.day, q.w * c.scale as w from q join c using (day)), u as (select day, sum(abs(w - coalesce(before, 0))) / 2 as turnover from (select *, lag(w) over (partition by sym order by day) as before from t) group by day)
select day, n, round(scale, 6) as scale, round(scale * raw, 8) as ret, round(turnover, 6) as turnover from c join u using (day)"""
)
def momentum_sleeve(spark: SparkSession, folder: str) -> DataFrame:
    """By month the fifth that rose most over a year but its last month against the fifth that rose least, scaled by the deviation of the sleeve's own last 12 months, with its turnover."""
    w = by_sym()
    x = bars_m(spark, folder).select("sym", "day", (div(F.lag("close").over(w), F.lag("close", 12).over(w)) - 1).alias("mom"), (F.lead("close").over(w) / F.col("close") - 1).alias("nxt")).where("mom is not null")
    day = W.partitionBy("day")
    q = x.select("sym", "day", "nxt", F.row_number().over(day.orderBy("mom", "sym")).alias("i"), F.count("*").over(day).alias("n")).where("n >= 20").withColumn("fifth", F.floor(F.col("n") / 5))
    q = q.withColumn("w", F.when(F.col("i") > F.col("n") - F.col("fifth"), 1.0).when(F.col("i") <= F.col("fifth"), -1.0).otherwise(0.0) / F.col("fifth"))
    h = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-12, -1)  # one row for each month
    c = q.groupBy("day", "n").agg(F.sum(F.col("w") * F.col("nxt")).alias("raw")).select("*", F.stddev_samp("raw").over(h).alias("dev"), F.count("raw").over(h).alias("months")).where("months >= 6")
    c = c.withColumn("scale", F.least(div(F.lit(0.1), F.col("dev") * math.sqrt(12)), F.lit(2.0)))
    t = q.join(c.select("day", "scale"), "day").select("sym", "day", (F.col("w") * F.col("scale")).alias("w"))
    u = t.withColumn("before", F.lag("w").over(by_sym())).groupBy("day").agg((F.sum(F.abs(F.col("w") - F.coalesce("before", F.lit(0.0)))) / 2).alias("turnover"))
    return c.join(u, "day").select("day", "n", F.round("scale", 6).alias("scale"), F.round(F.col("scale") * F.col("raw"), 8).alias("ret"), F.round("turnover", 6).alias("turnover"))


@query(
    using("bars_m")
    + """, m as (select day, avg(close) as mc from bars_m group by day), r as (select b.sym, b.day, b.close / lag(b.close) over w - 1 as r, m.mc / lag(m.mc) over w - 1 as rm, lead(b.close) over w / b.close - 1 as nxt from bars_m b join m using (day) window w as (partition by b.sym order by b.day)),
b as (select *, covar_samp(r, rm) over h / nullif(var_samp(rm) over h, 0) as beta, count(r) over h as k from r where r is not null window h as (partition by sym order by day rows between 24 preceding and 1 preceding)), e as (select *, r - beta * rm as e from b where k >= 12),
s as (select *, -sum(e) over three / nullif(stddev_samp(e) over long, 0) as score, count(e) over long as n from e window three as (partition by sym order by day rows between 2 preceding and current row), long as (partition by sym order by day rows between 23 preceding and current row)),
k as (select *, row_number() over (partition by day order by score, sym) as i, count(*) over (partition by day) as names from s where n >= 6 and score is not null and nxt is not null), d as (select day, any_value(names) as names, avg(nxt) filter (where i > names - greatest(1, names // 10)) - avg(nxt) filter (where i <= greatest(1, names // 10)) as ret from k where names >= 20 group by day)
select day, names, round(ret, 8) as ret, round(avg(ret) over (order by day rows between 2 preceding and current row), 8) as book from d"""
)
def residual_reversal(spark: SparkSession, folder: str) -> DataFrame:
    """By month the tenth whose residuals against the market fell most over three months, in their own deviations, against the tenth whose rose most; and the book that overlaps three months."""
    w, b = by_sym(), bars_m(spark, folder)
    x = b.join(b.groupBy("day").agg(F.avg("close").alias("mc")), "day")
    x = x.select("sym", "day", back("close", 1, w).alias("r"), back("mc", 1, w).alias("rm"), (F.lead("close").over(w) / F.col("close") - 1).alias("nxt")).where("r is not null")
    h, three, long = w.rowsBetween(-24, -1), w.rowsBetween(-2, 0), w.rowsBetween(-23, 0)
    x = x.select("*", div(F.covar_samp("r", "rm").over(h), F.var_samp("rm").over(h)).alias("beta"), F.count("r").over(h).alias("k")).where("k >= 12").withColumn("e", F.col("r") - F.col("beta") * F.col("rm"))
    x = x.select("sym", "day", "nxt", div(-F.sum("e").over(three), F.stddev_samp("e").over(long)).alias("score"), F.count("e").over(long).alias("n")).where("n >= 6 and score is not null and nxt is not null")
    day = W.partitionBy("day")
    k = x.select("day", "nxt", F.row_number().over(day.orderBy("score", "sym")).alias("i"), F.count("*").over(day).alias("names")).where("names >= 20").withColumn("tenth", F.greatest(F.lit(1), F.floor(F.col("names") / 10)))
    mean = lambda c: F.avg(F.when(c, F.col("nxt")))
    d = k.groupBy("day", "names").agg((mean(F.col("i") > F.col("names") - F.col("tenth")) - mean(F.col("i") <= F.col("tenth"))).alias("ret"))
    return d.select("day", "names", F.round("ret", 8).alias("ret"), F.round(F.avg("ret").over(W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-2, 0)), 8).alias("book"))  # one row for each month

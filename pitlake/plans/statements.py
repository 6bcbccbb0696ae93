"""Statements and what follows from them: quarters taken from years, ratios, capital costs, peers, factors, and what was known of an issuer on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions import finance
from pitlake.functions.columns import back, clip, div
from pitlake.functions.quantiles import exact_quantiles
from pitlake.operators.flows import fourth_quarters, from_year_to_date
from pitlake.operators.regression import regressions
from pitlake.plans.registry import query
from pitlake.plans.views import bars_m, using
from pitlake.plans.windows import by_sym
from pitlake.sources.tables import table

#: Facts as companies report them, from the orders of each customer: years, and quarters but for the last of every odd customer's years.
_FACTS = """with o as (select o_custkey as entity, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18,2)) as v from orders), q as (select entity, cast(date_trunc('quarter', day) as date) as start, cast(sum(v) as double) as value from o group by 1, 2),
y as (select entity, cast(date_trunc('year', day) as date) as start, cast(sum(v) as double) as value from o group by 1, 2),
facts as (select entity, start, cast(start + interval 3 months - interval 1 day as date) as finish, value from q where not (month(start) = 10 and entity % 2 = 1) union all select entity, start, cast(start + interval 1 year - interval 1 day as date), value from y)"""


def _sums(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", unit).alias("start"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return o.groupBy("entity", "start").agg(F.sum("v").cast("double").alias("value"))


@query(
    _FACTS
    + """, n as (select y.entity, y.start as y0, y.finish as y1, y.value as whole, count(*) as n, sum(q.value) as three, max(q.finish) as last from facts y join facts q on q.entity = y.entity and q.start >= y.start and q.finish <= y.finish and q.finish - q.start + 1 between 80 and 100 where y.finish - y.start + 1 between 350 and 380 group by all)
select entity, cast(last + 1 as date) as start, y1 as finish, round(whole - three, 2) + 0.0 as value from n where n = 3 and y1 - last between 80 and 100"""
)
def fourth_quarter(spark: SparkSession, folder: str) -> DataFrame:
    """Last quarters that were never reported, from the year's own figure less the three quarters inside it: the facts have years and quarters, but not those."""
    q, y = _sums(spark, folder, "quarter"), _sums(spark, folder, "year")
    q = q.where("not (month(start) = 10 and entity % 2 = 1)").select("entity", "start", F.date_sub(F.add_months("start", 3), 1).alias("finish"), "value")
    facts = q.unionByName(y.select("entity", "start", F.date_sub(F.add_months("start", 12), 1).alias("finish"), "value"))
    return fourth_quarters(facts, "entity").select("entity", "start", "finish", (F.round("value", 2) + 0.0).alias("value"))


@query(
    """with o as (select o_custkey as entity, cast(date_trunc('year', o_orderdate) as date) as start, quarter(o_orderdate) as k, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v from orders group by 1, 2, 3),
f as (select entity, start, cast(start + to_months(cast(3 * k as int)) - interval 1 day as date) as finish, sum(v) over (partition by entity, start order by k) as value, k, lag(k) over (partition by entity, start order by k) as k0, lag(sum(v) over (partition by entity, start order by k)) over (partition by entity, start order by k) as before from o window w as (partition by entity, start)),
g as (select * from f), y as (select entity, start, value as year from g where k = 4)
select g.entity, g.start, g.finish, case when g.k - coalesce(g.k0, 0) = 1 then round(g.value - coalesce(g.before, 0), 2) end as flow, round(y.year + g.value - p.value, 2) as trailing
from g left join y on y.entity = g.entity and y.start = g.start - interval 1 year left join g p on p.entity = g.entity and p.start = g.start - interval 1 year and p.k = g.k and y.year is not null""".replace(
        "sum(v) over (partition by entity, start order by k) as value, k, lag(k) over (partition by entity, start order by k) as k0, lag(sum(v) over (partition by entity, start order by k)) over (partition by entity, start order by k) as before from o window w as (partition by entity, start)",
        "value, k, lag(k) over w as k0, lag(value) over w as before from (select entity, start, k, sum(v) over (partition by entity, start order by k) as value from o) window w as (partition by entity, start order by k)",
    )
)
def trailing_from_year_to_date(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly flows and trailing years of facts that are only known from the year's beginning: customers' orders, cumulative to each quarter in which they ordered."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "year").alias("start"), F.quarter("o_orderdate").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    q = o.groupBy("entity", "start", "k").agg(F.sum("v").cast("double").alias("v"))
    facts = q.select("entity", "start", F.date_sub(F.add_months("start", 3 * F.col("k")), 1).alias("finish"), F.sum("v").over(W.partitionBy("entity", "start").orderBy("k")).alias("value"))
    return from_year_to_date(facts, "entity").select("entity", "start", "finish", F.round("flow", 2).alias("flow"), F.round("trailing", 2).alias("trailing"))


_ITEMS = {
    "revenue": "ext", "cogs": "ext * 6 * disc", "net_income": "ext * (0.3 - 4 * disc)", "ebit": "ext * (0.5 - 6 * disc + tax)", "operating_income": "ext * (0.5 - 6 * disc)", "operating_cash_flow": "ext * (0.35 - 4 * tax)", "capex": "ext * tax", "interest_expense": "ext * tax / 4",
    "current_assets": "ext * (0.2 + disc)", "inventory": "ext * disc", "current_liabilities": "ext * (0.1 + tax)", "total_debt": "ext * 3 * tax", "total_equity": "ext * (0.4 + tax)", "total_assets": "ext * (0.9 + disc + tax)", "total_liabilities": "ext * (0.5 + disc)", "retained_earnings": "ext * (0.1 - disc)",
    "working_capital": "ext * (0.1 + disc - tax)", "nopat": "ext * (0.4 - 5 * disc)", "invested_capital": "ext * (0.6 + 3 * tax)", "market_cap": "ext * (1 + 5 * disc)", "enterprise_value": "ext * (1.2 + 5 * disc)", "ebitda": "ext * (0.55 - 6 * disc + tax)", "shares": "qty",
}
_Q4_SQL = "gross_margin: (revenue - cogs) / revenue|operating_margin: operating_income / revenue|net_margin: net_income / revenue|current_ratio: current_assets / current_liabilities|quick_ratio: (current_assets - inventory) / current_liabilities|debt_to_equity: total_debt / total_equity|interest_coverage: ebit / interest_expense|return_on_equity: net_income / average_equity|return_on_invested_capital: nopat / invested_capital|free_cash_flow_yield: (operating_cash_flow - capex) / market_cap|price_to_earnings: price / eps|ev_to_ebitda: enterprise_value / ebitda|peg_ratio: (price / eps) / eps_growth_pct"


def _guarded(of: str) -> str:
    top, bottom = of.rsplit(" / ", 1)
    return f"({top.replace('price / eps', 'price / nullif(eps, 0)')}) / nullif({bottom}, 0)"


@query(
    """with l as (select l_suppkey as entity, year(l_shipdate) as yr, l_extendedprice as ext, l_discount as disc, l_tax as tax, l_quantity as qty from lineitem), s as (select entity, yr, """
    + ", ".join(f"round(cast(sum({e}) as double), 4) as {k}" for k, e in _ITEMS.items())
    + """ from l group by 1, 2), p as (select *, net_income / shares as eps, market_cap / shares as price from s), w as (select *, lag(total_equity) over w as e0, lag(eps) over w as eps0, """
    + ", ".join(f"lag({k}) over w as b_{k}" for k in ("net_income", "total_assets", "total_debt", "current_assets", "current_liabilities", "shares", "revenue", "cogs"))
    + """ from p window w as (partition by entity order by yr)), x as (select *, (total_equity + coalesce(e0, total_equity)) / 2 as average_equity, 100 * (eps / nullif(eps0, 0) - 1) as eps_growth_pct from w)
select entity, yr, """
    + ", ".join(f"round({_guarded(f.split(': ')[1])}, 5) as {f.split(': ')[0]}" for f in _Q4_SQL.split("|"))
    + """, round(operating_cash_flow - capex, 4) as free_cash_flow, round(1.2 * working_capital / nullif(total_assets, 0) + 1.4 * retained_earnings / nullif(total_assets, 0) + 3.3 * ebit / nullif(total_assets, 0) + 0.6 * market_cap / nullif(total_liabilities, 0) + revenue / nullif(total_assets, 0), 5) as altman,
cast(coalesce(net_income > 0, false) as int) + cast(coalesce(operating_cash_flow > 0, false) as int) + cast(coalesce(net_income / total_assets > b_net_income / b_total_assets, false) as int) + cast(coalesce(operating_cash_flow > net_income, false) as int) + cast(coalesce(total_debt / total_assets < b_total_debt / b_total_assets, false) as int)
+ cast(coalesce(current_assets / current_liabilities > b_current_assets / b_current_liabilities, false) as int) + cast(coalesce(shares <= b_shares, false) as int) + cast(coalesce((revenue - cogs) / revenue > (b_revenue - b_cogs) / b_revenue, false) as int) + cast(coalesce(revenue / total_assets > b_revenue / b_total_assets, false) as int) as piotroski from x"""
)
def statement_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Fourteen ratios, Altman's Z and Piotroski's F of each supplier's years, against the year before, from items that are sums over its lines."""
    li = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("yr"), F.col("l_extendedprice").alias("ext"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("qty"))
    s = li.groupBy("entity", "yr").agg(*[F.round(F.sum(F.expr(e)).cast("double"), 4).alias(k) for k, e in _ITEMS.items()])
    s = s.withColumn("eps", div(F.col("net_income"), F.col("shares"))).withColumn("price", div(F.col("market_cap"), F.col("shares")))
    w = W.partitionBy("entity").orderBy("yr")
    s = s.select("*", *[F.lag(c).over(w).alias(f"b_{c}") for c in (*_ITEMS, "eps")])
    s = s.withColumn("average_equity", (F.col("total_equity") + F.coalesce("b_total_equity", "total_equity")) / 2).withColumn("eps_growth_pct", 100 * (div(F.col("eps"), F.col("b_eps")) - 1))
    f = finance.piotroski({k: F.col(k) for k in _ITEMS}, {k: F.col(f"b_{k}") for k in _ITEMS})
    return s.select(
        "entity", "yr", *[F.round(finance.ratio(k), 5).alias(k) for k in finance.RATIOS], F.round(F.col("operating_cash_flow") - F.col("capex"), 4).alias("free_cash_flow"), F.round(finance.altman(), 5).alias("altman"), f.alias("piotroski")
    )


@query(
    """with p as (select p_partkey, p_brand, p_retailprice as price, cast(p_size as double) as size from part), m as (select *, price / nullif(size, 0) as multiple from p), e as (select p_brand, quantile_cont(multiple, 0.1) as lo, quantile_cont(multiple, 0.9) as hi, median(multiple) as mid from m group by 1),
t as (select p_brand, avg(multiple) filter (where multiple between lo and hi) as trimmed, any_value(mid) as mid from m join e using (p_brand) group by 1)
select p_partkey, round(trimmed * size, 4) as implied, round(price / (trimmed * size) - 1, 6) as premium, round(0.03 + size / 50 * 0.05, 6) as equity_cost, round((price * (0.03 + size / 50 * 0.05) + size * 20 * 0.04 * (1 - 0.21)) / (price + size * 20), 6) as capital_cost, round(price * 1.05 * 1.04 * 1.03, 4) as third_year from m join t using (p_brand)"""
)
def peer_values(spark: SparkSession, folder: str) -> DataFrame:
    """Each part against its brand's multiples without their outer tenths, its costs of equity and capital, and three years of falling growth."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))
    m = p.withColumn("multiple", div(F.col("price"), F.col("size")))
    e = exact_quantiles(m, ["p_brand"], {"q": F.col("multiple")}, (0.1, 0.9)).select("p_brand", "q_0", "q_1")
    t = m.join(e, "p_brand").groupBy("p_brand").agg(F.avg(F.when(F.col("multiple").between(F.col("q_0"), F.col("q_1")), F.col("multiple"))).alias("trimmed"))
    x = m.join(t, "p_brand").withColumn("implied", F.col("trimmed") * F.col("size")).withColumn("equity_cost", finance.equity_cost(F.lit(0.03), F.col("size") / 50, F.lit(0.05)))
    wacc = finance.capital_cost(F.col("price"), F.col("size") * 20, F.col("equity_cost"), F.lit(0.04), F.lit(0.21))
    third = finance.grown(F.col("price"), [F.lit(0.05), F.lit(0.04), F.lit(0.03)])[2]
    return x.select("p_partkey", F.round("implied", 4).alias("implied"), F.round(div(F.col("price"), F.col("implied")) - 1, 6).alias("premium"), F.round("equity_cost", 6).alias("equity_cost"), F.round(wacc, 6).alias("capital_cost"), F.round(third, 4).alias("third_year"))


@query(
    using("bars_m")
    + """, r as (select sym, day, close / lag(close) over (partition by sym order by day) - 1 as r from bars_m), a as (select sym, count(*) as n, avg(r) as m, stddev_samp(r) as s, sqrt(avg(r * r) filter (where r < 0)) as d, avg(case when r > 0 then 1.0 else 0.0 end) as w, avg(r) filter (where r > 0) / nullif(-avg(r) filter (where r < 0), 0) as o from r where r is not null group by 1)
select sym, n, round(case when s < 1e-12 then 0 else m / s * sqrt(12) end, 5) as sharpe, round(coalesce(m / nullif(d, 0) * sqrt(12), 0), 5) as sortino, case when w > 0 and w < 1 and o > 0 then round(least(greatest((w - (1 - w) / o) * 0.5, 0), 1), 6) end as kelly from a"""
)
def risk_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Sharpe and Sortino ratios of each symbol's months, and half the stake that grows fastest by its wins and odds."""
    x = bars_m(spark, folder).select("sym", back("close", 1, by_sym()).alias("r")).where("r is not null")
    r = F.col("r")
    a = x.groupBy("sym").agg(F.count("*").alias("n"), finance.sharpe(r, 12.0).alias("sharpe"), finance.sortino(r, 12.0).alias("sortino"), F.avg((r > 0).cast("double")).alias("w"), div(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))).alias("o"))
    return a.select("sym", "n", F.round("sharpe", 5).alias("sharpe"), F.round("sortino", 5).alias("sortino"), F.round(finance.kelly(F.col("w"), F.col("o")), 6).alias("kelly"))


@query(
    using("bars_m")
    + """, n as (select s_suppkey as sym, n_regionkey as sector from supplier join nation on n_nationkey = s_nationkey), k as (select b.sym, b.day, n.sector, b.close, avg(close) over (partition by day) as mc, avg(close) over (partition by sector, day) as sc from bars_m b join n using (sym)),
x as (select sym, close / lag(close) over w - 1 as y, mc / lag(mc) over w - 1 as a, sc / lag(sc) over w - 1 as b from k window w as (partition by sym order by day)),
s as (select sym, count(*) as n, regr_sxx(a, a) as aa, regr_sxx(b, b) as bb, regr_sxy(a, b) as ab, regr_sxy(a, y) as ay, regr_sxy(b, y) as by_, regr_sxx(y, y) as yy from x where y is not null group by 1 having count(*) > 10),
c as (select *, aa * bb - ab * ab as det from s), d as (select *, (bb * ay - ab * by_) / det as ba, (aa * by_ - ab * ay) / det as bb_ from c where det > 1e-12), e as (select *, yy - ba * ay - bb_ * by_ as rss from d)
select sym, n, round(ba, 5) as market, round(bb_, 5) as sector, round(ba / sqrt(rss / (n - 3) * bb / det), 3) as t_market, round(bb_ / sqrt(rss / (n - 3) * aa / det), 3) as t_sector, round(1 - rss / yy, 6) as r2, round(1000 * (1 + ba * -0.2 + bb_ * 0.05), 2) as stressed from e where rss > 0"""
)
def factor_regressions(spark: SparkSession, folder: str) -> DataFrame:
    """Each symbol's months on market and sector: weights, t statistics, R squared, and 1,000 after a fall of the market by a fifth and a rise of the sector."""
    n = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    d = table(spark, folder, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").alias("sector"))  # 25 nations
    b = bars_m(spark, folder).join(d, "sym").select("sym", "day", "sector", "close")
    market, sector = b.groupBy("day").agg(F.avg("close").alias("mc")), b.groupBy("sector", "day").agg(F.avg("close").alias("sc"))
    x = b.join(market, "day").join(sector, ["sector", "day"]).select("sym", back("close", 1, by_sym()).alias("y"), back("mc", 1, by_sym()).alias("a"), back("sc", 1, by_sym()).alias("b"))
    g = regressions(x, ["sym"], ["a", "b"], "y").where("n > 10 and rss > 0")
    w = {"market": F.col("weights")[1], "sector": F.col("weights")[2]}
    return g.select(
        "sym", "n", *[F.round(v, 5).alias(k) for k, v in w.items()], F.round(F.col("t")[1], 3).alias("t_market"), F.round(F.col("t")[2], 3).alias("t_sector"), F.round("r2", 6).alias("r2"),
        F.round(finance.stressed(F.lit(1000.0), w, {"market": -0.2, "sector": 0.05}), 2).alias("stressed"),
    )


#: Days after which a report's age counts no more, and the days ahead of a release a year before in which the next is expected.
AGE, AHEAD = 180, 10


@query(
    f"""with f as (select distinct q.fact_id, i.ticker, q.period_end, q.value, q.first_filed as filed from quarters q join issuers i using (cik) where q.source = 'sec_xbrl' and q.value is not null and q.first_filed is not null and q.period_end is not null), m as (select ticker, period_end, filed, arg_max(value, fact_id) as value from f group by 1, 2, 3),
v as (select *, lead(filed) over (partition by ticker, period_end order by filed) as until from m), c as (select distinct cast(date_trunc('quarter', filed) + interval 3 months as date) as day from m),
k as (select c.day, v.ticker, v.period_end, v.value, v.filed from v join c on v.filed < c.day and (v.until is null or v.until >= c.day) and v.period_end > c.day - interval 66 months and v.period_end <= c.day),
s as (select *, value - lag(value, 4) over w as ch, last_value(value) over (partition by day, ticker order by period_end range between interval 390 days preceding and interval 340 days preceding) as prior, row_number() over (partition by day, ticker order by period_end desc) as r from k window w as (partition by day, ticker order by period_end)),
u as (select *, stddev_pop(ch) over h as sd, count(ch) over h as n from s window h as (partition by day, ticker order by period_end rows between 8 preceding and 1 preceding)),
z as (select *, case when n >= 4 and sd > 1e-9 then least(greatest(ch / sd, -5), 5) end as sue from u), g as (select day, ticker, max(case when r = 1 then sue end) as s1, max(case when r = 2 then sue end) as s2, max(case when r = 3 then sue end) as s3, max(case when r = 4 then sue end) as s4,
  max(case when r = 1 and abs(prior) > 1e-9 then least(greatest((value - prior) / abs(prior), -1), 3) end) as yoy, least({AGE}, max(case when r = 1 then date_diff('day', filed, day) end)) as age from z where r <= 4 group by 1, 2),
d as (select distinct ticker, published_on as on_, doc_kind from documents where published_on is not null and ticker is not null and doc_kind in ('earnings_release', 'filing')), e as (select g.day, g.ticker, max(case when doc_kind = 'earnings_release' and on_ < g.day then on_ end) as last, count(case when on_ < g.day and on_ >= g.day - 30 then 1 end) as recent,
  max(case when doc_kind = 'earnings_release' and on_ > g.day - 364 and on_ <= g.day - 364 + {AHEAD} then 1 else 0 end) as expected from g join d using (ticker) group by 1, 2)
select day, ticker, round(coalesce(s1, 0), 4) + 0.0 as sue_1, round(coalesce(s2, 0), 4) + 0.0 as sue_2, round(coalesce(s3, 0), 4) + 0.0 as sue_3, round(coalesce(s4, 0), 4) + 0.0 as sue_4, round(coalesce(yoy, 0), 4) + 0.0 as yoy, cast(age as int) as days_since_report, cast(coalesce(least({AGE}, day - last), {AGE}) as int) as days_since_release, coalesce(recent, 0) as releases_30d,
  cast(coalesce(expected, 0) as int) as expected, s1 is not null as known from g left join e using (day, ticker)"""
)
def fundamentals_known(spark: SparkSession, folder: str) -> DataFrame:
    """What was known of an issuer at the beginning of each quarter: four surprises, growth, the age of report and release, releases of the month, one expected.

    Each version of a figure is known from the day after its filing to the next one's; it is set into the quarters' beginnings in between, for at most 66 months
    after its period, and windows run by issuer and day. So an issuer with a third of all facts spreads over the days. Nothing filed on the day or later counts.
    """
    i = table(spark, folder, "issuers").select("cik", "ticker")
    q = table(spark, folder, "quarters").where("source = 'sec_xbrl' and value is not null and first_filed is not null and period_end is not null").join(i, "cik")
    m = q.groupBy("ticker", "period_end", F.col("first_filed").alias("filed")).agg(F.max_by("value", "fact_id").alias("value"))
    v = m.withColumn("until", F.lead("filed").over(W.partitionBy("ticker", "period_end").orderBy("filed")))
    days = m.select(F.add_months(F.trunc("filed", "quarter"), 3).alias("day")).distinct()
    last = days.agg(F.max("day")).first()[0]  # one day
    first = F.greatest(F.date_add("filed", 1), "period_end")
    first = F.when(F.trunc(first, "quarter") == first, first).otherwise(F.add_months(F.trunc(first, "quarter"), 3))
    stop = F.least(F.coalesce("until", F.lit(last)), F.date_sub(F.add_months("period_end", 66), 1), F.lit(last))
    k = v.withColumn("_first", first).withColumn("_stop", stop).where("_first <= _stop").select("ticker", "period_end", "value", "filed", F.explode(F.expr("sequence(_first, _stop, interval 3 months)")).alias("day")).join(days, "day", "left_semi")
    own = W.partitionBy("day", "ticker")
    w = own.orderBy("period_end")
    x = k.select("*", (F.col("value") - F.lag("value", 4).over(w)).alias("ch"), F.last("value").over(own.orderBy(F.unix_date("period_end")).rangeBetween(-390, -340)).alias("prior"), F.row_number().over(own.orderBy(F.desc("period_end"))).alias("r"))
    h = w.rowsBetween(-8, -1)
    x = x.select("*", F.stddev_pop("ch").over(h).alias("sd"), F.count("ch").over(h).alias("n")).where("r <= 4")
    sue = F.when((F.col("n") >= 4) & (F.col("sd") > 1e-9), clip(F.col("ch") / F.col("sd"), -5, 5))
    at = lambda r, c: F.max(F.when(F.col("r") == r, c))
    growth = F.when(F.abs("prior") > 1e-9, clip((F.col("value") - F.col("prior")) / F.abs("prior"), -1, 3))
    g = x.groupBy("day", "ticker").agg(*[at(r, sue).alias(f"s{r}") for r in (1, 2, 3, 4)], at(1, growth).alias("yoy"), F.least(F.lit(AGE), at(1, F.datediff("day", "filed"))).alias("age"))
    # releases, in the quarters in which they may count: 180 days back for their age, a year for the next one's date
    d = table(spark, folder, "documents").where("published_on is not null and ticker is not null and doc_kind in ('earnings_release', 'filing')").select(F.col("ticker").alias("_t"), F.col("published_on").alias("on"), "doc_kind").distinct()
    d = d.withColumn("day", F.explode(F.sequence(F.add_months(F.trunc(F.date_add("on", 1), "quarter"), 0), F.date_add("on", 400), F.expr("interval 3 months"))))
    release = F.col("doc_kind") == "earnings_release"
    e = d.groupBy(F.col("day").alias("_d"), "_t").agg(
        F.max(F.when(release & (F.col("on") < F.col("day")), F.col("on"))).alias("last"), F.count(F.when((F.col("on") < F.col("day")) & (F.col("on") >= F.date_sub("day", 30)), 1)).alias("recent"),
        F.max((release & (F.col("on") > F.date_sub("day", 364)) & (F.col("on") <= F.date_sub("day", 364 - AHEAD))).cast("int")).alias("expected"),
    )
    y = g.join(e, (F.col("day") == F.col("_d")) & (F.col("ticker") == F.col("_t")), "left")
    zero = lambda c: (F.round(F.coalesce(c, F.lit(0.0)), 4) + 0.0)
    return y.select(
        "day", "ticker", *[zero(f"s{r}").alias(f"sue_{r}") for r in (1, 2, 3, 4)], zero("yoy").alias("yoy"), F.col("age").alias("days_since_report"), F.coalesce(F.least(F.lit(AGE), F.datediff("day", "last")), F.lit(AGE)).alias("days_since_release"),
        F.coalesce("recent", F.lit(0)).cast("bigint").alias("releases_30d"), F.coalesce("expected", F.lit(0)).alias("expected"), F.col("s1").isNotNull().alias("known"),
    )

"""Books over time, rolling performance, execution reports, category and name rules, implied deviations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import back, div, normal_cdf, normal_cdf_array, normal_ppf
from pitlake.functions.quantiles import exact_quantiles
from pitlake.plans.registry import query
from pitlake.plans.scores import _cdf_sql
from pitlake.plans.views import bars_m, preds, px_d, using
from pitlake.plans.windows import by_day, by_sym
from pitlake.sources.tables import table


@query(
    """with l as (select distinct client_order_id, status, side, qty, ref_price, filled_price from legs) select status, side, count(*) as n, count(filled_price) as filled, round(avg((filled_price / ref_price - 1) * case side when 'buy' then 1 else -1 end), 8) + 0.0 as mean_gap, round(max(abs(filled_price / ref_price - 1)), 8) as worst from l group by 1, 2"""
)
def execution_report(spark: SparkSession, folder: str) -> DataFrame:
    """Legs by status and side: counts, mean and worst gap between reference and fill."""
    x = table(spark, folder, "legs").select("client_order_id", "status", "side", "qty", "ref_price", "filled_price").distinct()
    gap = div(F.col("filled_price"), F.col("ref_price")) - 1
    return x.groupBy("status", "side").agg(
        F.count("*").alias("n"), F.count("filled_price").alias("filled"), (F.round(F.avg(gap * F.when(F.col("side") == "buy", 1).otherwise(-1)), 8) + 0.0).alias("mean_gap"), F.round(F.max(F.abs(gap)), 8).alias("worst")
    )


@query(using("px_d") + " select day, round(close, 6) as close from (select *, row_number() over (order by day) as k from px_d) where (k - 1) % 5 = 0")
def every_fifth_day(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth trading day from the first: the feature is the step."""
    return px_d(spark, folder).withColumn("k", F.row_number().over(by_day())).where("(k - 1) % 5 = 0").select("day", F.round("close", 6).alias("close"))


def renamed_fields(record: Column, aliases: dict[str, str], wanted: list[str]) -> tuple[Column, Column]:
    """(a map with canonical names and only the wanted fields, the wanted fields that are missing). Of several aliases of a field the last in order stands."""
    names = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    entries = F.transform(F.map_entries(record), lambda e: F.struct(F.coalesce(F.try_element_at(names, F.lower(e["key"])), F.lower(e["key"])).alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: e["key"].isin(*wanted) & e["value"].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda e: e["key"]))
    canonical = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(kept, lambda e: e["key"] == k), -1)["value"]))
    return canonical, F.array_except(F.array(*[F.lit(w) for w in wanted]), keys)


@query(
    """select p_partkey, cast(p_size as double) as revenue, case when p_partkey % 3 = 0 then cast(p_partkey % 50 as double) end as income, case when p_partkey % 3 = 0 then 'assets' else 'income,assets' end as missing from part"""
)
def canonical_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of records under one set of names, with what is missing."""
    p = table(spark, folder, "part").select("p_partkey", "p_size")
    income = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.pmod("p_partkey", F.lit(50)).cast("double"))
    record = F.create_map(F.lit("TotalRevenue"), F.col("p_size").cast("double"), F.lit("NetIncome"), income, F.lit("Other"), F.lit(1.0))
    fields, missing = renamed_fields(record, {"totalrevenue": "revenue", "netincome": "income"}, ["revenue", "income", "assets"])
    return p.select("p_partkey", fields.alias("f"), missing.alias("m")).select("p_partkey", F.try_element_at("f", F.lit("revenue")).alias("revenue"), F.try_element_at("f", F.lit("income")).alias("income"), F.array_join("m", ",").alias("missing"))


_CATEGORY = [("distress", "1.03,2.04,3.01"), ("restructuring", "2.05,2.06"), ("deal", "1.01,2.01"), ("leadership", "5.02")]


def first_category(items: Column, ladder: list[tuple[str, str]]) -> Column:
    """The first category of the ladder that one of the items belongs to; null if none."""
    return F.coalesce(*[F.when(F.arrays_overlap(items, F.array(*[F.lit(i) for i in codes.split(",")])), F.lit(name)) for name, codes in ladder])


@query(
    "with o as (select o_orderkey, [['1.01','9.01'],['5.02'],['2.05','5.02'],['8.01'],['3.01','1.01'],['2.04']][cast(o_orderkey % 6 as int) + 1] as items from orders), c as (select o_orderkey, case when list_has_any(items, ['1.03','2.04','3.01']) then 'distress' when list_has_any(items, ['2.05','2.06']) then 'restructuring' when list_has_any(items, ['1.01','2.01']) then 'deal' when list_has_any(items, ['5.02']) then 'leadership' end as category from o) select category, count(*) as n from c group by 1"
)
def item_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Filings by the first category that their items reach."""
    lists = F.array(*[F.array(*[F.lit(i) for i in x.split(",")]) for x in ("1.01,9.01", "5.02", "2.05,5.02", "8.01", "3.01,1.01", "2.04")])
    o = table(spark, folder, "orders").select(F.element_at(lists, (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int")).alias("items"))
    return o.groupBy(first_category(F.col("items"), _CATEGORY).alias("category")).agg(F.count("*").alias("n"))


@query(
    r"""select cik, trim(regexp_replace(regexp_replace(lower(company), '\([^)]*\)|\bclass [a-c]\b', '', 'g'), '\b(inc|corp|corporation|company|co|ltd|plc|holdings|group)\b\.?', '', 'g'), ' ') as name from (select distinct cik, company from issuers) where company is not null"""
)
def company_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names without share classes, brackets and legal forms."""
    x = table(spark, folder, "issuers").select("cik", "company").distinct().where("company is not null")
    name = F.regexp_replace(F.regexp_replace(F.lower("company"), r"\([^)]*\)|\bclass [a-c]\b", ""), r"\b(inc|corp|corporation|company|co|ltd|plc|holdings|group)\b\.?", "")
    return x.select("cik", F.trim(name).alias("name"))


@query(
    r"""with p as (select doc_id, generate_subscripts(s, 1) as k, unnest(s) as t from (select doc_id, regexp_split_to_array(text, '\n\n') as s from documents where text is not null)), q as (select doc_id, k, t from p where length(t) >= 40 and regexp_matches(lower(t), 'outlook|guidance|expect') and regexp_matches(t, '[0-9]'))
select doc_id, count(*) as n, first(sha256(t) order by k) as first_hash, cast(sum(length(t)) as bigint) as chars from q group by doc_id"""
)
def outlook_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs with an outlook word and a number, by text: arrays within the row, nothing is exploded or shuffled."""
    wanted = lambda t: (F.length(t) >= 40) & F.lower(t).rlike("outlook|guidance|expect") & t.rlike("[0-9]")
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", F.filter(F.split("text", "\n\n", -1), wanted).alias("p")).where("size(p) > 0")
    return x.select("doc_id", F.size("p").cast("bigint").alias("n"), F.sha2(F.col("p")[0], 256).alias("first_hash"), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t)).alias("chars"))


@query(
    using("px_d")
    + """, r as (select day, close / lag(close) over (order by day) - 1 as r, volume / lag(volume) over (order by day) - 1 as b from px_d) select day, round(avg(r) over w / stddev_samp(r) over w * sqrt(252), 4) as sharpe, round(regr_slope(r, b) over w, 4) as beta, round(stddev_samp(r) over w * sqrt(252), 6) as vol from r where r is not null and b is not null window w as (order by day rows 125 preceding) qualify count(*) over w = 126"""
)
def rolling_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Sharpe ratio, beta and deviation of the last 126 days."""
    w = by_day().rowsBetween(-125, 0)
    r = px_d(spark, folder).select("day", back("close", 1, by_day()).alias("r"), back("volume", 1, by_day()).alias("b")).where("r is not null and b is not null")
    x = r.select("day", F.avg("r").over(w).alias("m"), F.stddev_samp("r").over(w).alias("s"), F.regr_slope("r", "b").over(w).alias("beta"), F.count("*").over(w).alias("k")).where("k = 126")
    return x.select("day", F.round(div(F.col("m"), F.col("s")) * math.sqrt(252), 4).alias("sharpe"), F.round("beta", 4).alias("beta"), F.round(F.col("s") * math.sqrt(252), 6).alias("vol"))


@query(
    using("bars_m")
    + """, m as (select day, avg(close) as mc from bars_m group by day), r as (select b.sym, b.day, b.close / lag(b.close) over (partition by b.sym order by b.day) - 1 as r, m.mc / lag(m.mc) over (partition by b.sym order by b.day) - 1 as rm from bars_m b join m using (day))
select sym, round(avg(r) filter (where rm > 0) / nullif(avg(rm) filter (where rm > 0 and r is not null), 0), 4) as up, round(avg(r) filter (where rm < 0) / nullif(avg(rm) filter (where rm < 0 and r is not null), 0), 4) as down, round(avg(r - rm) / nullif(stddev_samp(r - rm), 0), 4) as information from r where r is not null group by sym"""
)
def capture_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Returns in rising and falling markets against the market's, and the information ratio, by symbol."""
    b = bars_m(spark, folder)
    x = b.join(b.groupBy("day").agg(F.avg("close").alias("mc")), "day").select("sym", "day", back("close", 1, by_sym()).alias("r"), back("mc", 1, by_sym()).alias("rm")).where("r is not null")
    mean = lambda v, c: F.avg(F.when(c, v))
    up, down, gap = F.col("rm") > 0, F.col("rm") < 0, F.col("r") - F.col("rm")
    return x.groupBy("sym").agg(F.round(div(mean(F.col("r"), up), mean(F.col("rm"), up)), 4).alias("up"), F.round(div(mean(F.col("r"), down), mean(F.col("rm"), down)), 4).alias("down"), F.round(div(F.avg(gap), F.stddev_samp(gap)), 4).alias("information"))


@query(
    "with q as (select distinct fact_id, value, unit_note, source from quarters where unit_note is null), r as (select exp(median(ln(value))) as ref from quarters where unit_note is not null and value > 0 and lower(trim(unit_note)) in ('usd', '$', 'us dollars')) select fact_id, case when value between 0.01 * ref and 100 * ref then 1 when value * 1e3 between 0.01 * ref and 100 * ref then 1000 when value * 1e6 between 0.01 * ref and 100 * ref then 1000000 end as factor from q, r"
)
def rescued_units(spark: SparkSession, folder: str) -> DataFrame:
    """A coarse rescue of figures without a unit: the first of three factors that brings them near the usual size; null if none does."""
    q = table(spark, folder, "quarters")
    ref = q.where("unit_note is not null and value > 0").where(F.lower(F.trim("unit_note")).isin("usd", "$", "us dollars"))
    ref = exact_quantiles(ref, [], {"v": F.log("value")}).first()  # one number
    ref = F.lit(math.exp(ref["v"]) if ref else None)
    near = lambda k: (F.col("value") * k).between(0.01 * ref, 100 * ref)
    x = q.where("unit_note is null").select("fact_id", "value", "unit_note", "source").distinct()
    return x.select("fact_id", F.when(near(1.0), 1).when(near(1e3), 1000).when(near(1e6), 1_000_000).cast("int").alias("factor"))


@query(
    using("preds")
    + """, w as (select arm, cutoff, avg(sign(p - 0.5) * ret) as r from preds where p <> 0.5 group by arm, cutoff), a as (select arm, avg(r) as mu, stddev_samp(r) as s, stddev_pop(r) as sp, count(*) as n from w group by arm),
m as (select w.arm, any_value(mu / s) as sr, any_value(n) as n, avg(pow((r - mu) / sp, 3)) as g1, avg(pow((r - mu) / sp, 4)) as k from w join a using (arm) group by w.arm), v as (select var_samp(sr) as v, count(*) as trials from m),
z as (select arm, n, sqrt(v) * ((1 - 0.5772156649) * 0.43072729929545756 + 0.5772156649 * 1.1605) as sr0, sr, g1, k from m, v) select arm, n, round((sr - sr0) * sqrt(n - 1) / sqrt(1 - g1 * sr + (k - 1) / 4 * sr * sr), 3) as z, round(sr0, 6) as threshold from z""".replace("1.1605", repr(__import__("statistics").NormalDist().inv_cdf(1 - 1 / (3 * math.e))))
)
def deflated_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    """How far each arm's Sharpe ratio lies above the best that as many unskilled arms would show by luck, in deviations."""
    w = preds(spark, folder).where("p <> 0.5").groupBy("arm", "cutoff").agg(F.avg(F.signum(F.col("p") - 0.5) * F.col("ret")).alias("r"))
    m = w.groupBy("arm").agg(F.count("*").alias("n"), div(F.avg("r"), F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("g1"), (F.kurtosis("r") + 3).alias("k"))
    trials, var = m.agg(F.count("*"), F.var_samp("sr")).first()  # two numbers
    luck = 0.0 if trials < 2 else math.sqrt(var) * spark.range(1).select(((1 - 0.5772156649) * normal_ppf(F.lit(1 - 1 / trials)) + 0.5772156649 * normal_ppf(F.lit(1 - 1 / (trials * math.e)))).alias("x")).first().x
    z = (F.col("sr") - luck) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("g1") * F.col("sr") + (F.col("k") - 1) / 4 * F.col("sr") * F.col("sr"))
    return m.select("arm", "n", F.round(z, 3).alias("z"), F.round(F.lit(luck), 6).alias("threshold"))


def call_price(strike: np.ndarray, deviation: np.ndarray, spot: float, rate: float, years: float) -> np.ndarray:
    """Calls in closed form, a column at a time."""
    with np.errstate(all="ignore"):
        d1 = (np.log(spot / strike) + (rate + deviation**2 / 2) * years) / (deviation * math.sqrt(years))
        return spot * normal_cdf_array(d1) - strike * math.exp(-rate * years) * normal_cdf_array(d1 - deviation * math.sqrt(years))


@query(
    "with o as (select c_custkey, 100.0::double as s, 80.0 + c_custkey % 41 as k, 0.1 + (c_custkey % 7) * 0.05 as v, 0.5 as t from customer), d as (select *, (ln(s / k) + (0.03 + v * v / 2) * t) / (v * sqrt(t)) as d1 from o), e as (select *, d1 - v * sqrt(t) as d2 from d) select c_custkey, round(s * ("
    + _cdf_sql("d1") + ") - k * exp(-0.03 * t) * (" + _cdf_sql("d2") + "), 4) as price, cast(round(v, 4) as double) as implied, cast(round(v, 4) as double) as true from e"
)
def implied_deviation(spark: SparkSession, folder: str) -> DataFrame:
    """The deviation that explains a call's price, found by halving an interval 40 times for a whole batch of options at once."""
    s, r, t = 100.0, 0.03, 0.5

    @F.pandas_udf("double")
    def implied(k: pd.Series, price: pd.Series) -> pd.Series:
        strike, want = k.to_numpy(float), price.to_numpy(float)
        low, high = np.full(len(k), 0.001), np.full(len(k), 3.0)
        for _ in range(40):
            middle = (low + high) / 2
            below = call_price(strike, middle, s, r, t) < want
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        return pd.Series((low + high) / 2)

    x = table(spark, folder, "customer").select("c_custkey", (80.0 + F.pmod("c_custkey", F.lit(41))).alias("k"), (0.1 + F.pmod("c_custkey", F.lit(7)) * 0.05).alias("v"))
    d1 = (F.log(F.lit(s) / F.col("k")) + (r + F.col("v") * F.col("v") / 2) * t) / (F.col("v") * math.sqrt(t))
    x = x.withColumn("d1", d1).withColumn("price", s * normal_cdf(F.col("d1")) - F.col("k") * math.exp(-r * t) * normal_cdf(F.col("d1") - F.col("v") * math.sqrt(t)))
    return x.select("c_custkey", F.round("price", 4).alias("price"), F.round(implied("k", "price"), 4).alias("implied"), F.round("v", 4).alias("true"))


@query(
    using("bars_m")
    + """, x as (select sym, day, open, close, lag(close) over w as last, case when close > lag(close, 3) over w then 1.0::double when close <= lag(close, 3) over w then 0.0::double end as weight from bars_m window w as (partition by sym order by day)),
h as (select *, coalesce(last_value(weight ignore nulls) over (partition by sym order by day rows between unbounded preceding and 1 preceding), 0) as held from x), b as (select *, coalesce(lag(held) over (partition by sym order by day), 0) as before from h),
f as (select *, case when last is null then 1.0 else (1 + before * (open / last - 1)) * (1 - abs(held - before) * 5 / 1e4) * (1 + held * (close / open - 1)) end as f from b)
select sym as key, day, round(exp(sum(ln(f)) over (partition by sym order by day)), 8) as equity, held, abs(held - before) as traded from f"""
)
def weight_books(spark: SparkSession, folder: str) -> DataFrame:
    """Equity of a trend book for each symbol: a target known at a close is traded at the next open and held until there is another, each trade costs 5 bp.

    What is held is the last target before the bar, so equity is a running product of each bar's factor, summed as logarithms; no state is carried.
    """
    w = by_sym()
    m = F.lag("close", 3).over(w)
    x = bars_m(spark, folder).select("sym", "day", "open", "close", F.lag("close").over(w).alias("last"), F.when(F.col("close") > m, 1.0).when(F.col("close") <= m, 0.0).alias("weight"))
    x = x.withColumn("held", F.coalesce(F.last("weight", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(0.0)))
    traded = F.abs(F.col("held") - F.col("before"))
    factor = F.when(F.col("last").isNull(), 1.0).otherwise((1 + F.col("before") * (F.col("open") / F.col("last") - 1)) * (1 - traded * 5 / 1e4) * (1 + F.col("held") * (F.col("close") / F.col("open") - 1)))
    return x.withColumn("f", F.log(factor)).select(F.col("sym").alias("key"), "day", F.round(F.exp(F.sum("f").over(w)), 8).alias("equity"), "held", traded.alias("traded"))

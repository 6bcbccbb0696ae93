"""Point-in-time queries: as-of joins, entry days, restated filings, seasonal surprises, forward outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import clip, div
from pitlake.operators.asof import asof_join, calendar, entry_day
from pitlake.plans.registry import query
from pitlake.plans.views import bars_m, filings, preds, px_d, using
from pitlake.sources.tables import table

#: The day on which the filings' queries look back; a parameter of theirs.
CUTOFF = "2020-06-30"


@query(
    using("bars_m")
    + """, e as (select o_orderkey as id, o_custkey % (select count(*) from supplier) as sym, cast(o_orderdate as date) as day from orders) select e.id, e.sym, e.day, b.day as bar_day, round(b.close, 9) as close from e asof left join bars_m b on e.sym = b.sym and e.day >= b.day"""
)
def asof_price_at_event(spark: SparkSession, folder: str) -> DataFrame:
    """Each order with the last monthly close of a symbol at or before its day; symbols are split by year."""
    n = max(table(spark, folder, "supplier").count(), 1)  # one number
    e = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(n)).cast("bigint").alias("sym"), F.col("o_orderdate").cast("date").alias("day"))
    b = bars_m(spark, folder).select("sym", F.col("day").alias("bar_day"), F.col("day").alias("t"), F.round("close", 9).alias("close"))
    return asof_join(e, b, ["sym"], "day", "t", ["bar_day", "close"], slot=F.year("_t"))


@query(
    using("px_d")
    + """, e as (select o_orderkey as id, o_orderdate + to_hours(cast(o_orderkey % 24 as int)) as at from orders) select id, (select min(day) from px_d where day >= cast(e.at as date) + case when hour(e.at) >= 13 then 1 else 0 end) as entry from e"""
)
def entry_index_events(spark: SparkSession, folder: str) -> DataFrame:
    """The first trading day on which an event can be acted on: its own before 13:00 UTC, else the next."""
    e = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.pmod("o_orderkey", F.lit(24)).cast("int"))).alias("at"))
    return entry_day(e, "at", calendar(px_d(spark, folder))).select("id", "entry")


@query(
    using("bars_m")
    + """, m as (select day, avg(close) as mc from bars_m group by day), k as (select day, mc, row_number() over (order by day) as i from m), f as (select b.sym, b.day, b.open, k.i from bars_m b join k using (day)),
g as (select a.sym, a.day, b.open / a.open - 1 as r, km.mc / k.mc - 1 as rm from f a join k on k.i = a.i join f b on b.sym = a.sym and b.i = a.i + 3 join k km on km.i = a.i + 3)
select sym, day, round(r, 6) as ret, round(r - rm, 6) as excess from g"""
)
def forward_excess(spark: SparkSession, folder: str) -> DataFrame:
    """Open-to-open return three calendar months ahead, less the market's: offsets are steps of the calendar, not of the symbol's own rows."""
    b = bars_m(spark, folder)
    m = b.groupBy("day").agg(F.avg("close").alias("mc")).withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("day")))  # one row a month
    m = m.select("day", "mc", "i", F.lead("mc", 3).over(W.partitionBy(F.lit(0)).orderBy("day")).alias("mc3"))
    x = b.join(m, "day").select("sym", "day", "i", "open", (F.col("mc3") / F.col("mc") - 1).alias("rm"))
    later = W.partitionBy("sym").orderBy("i").rangeBetween(3, 3)
    x = x.withColumn("o3", F.max("open").over(later)).where("o3 is not null")
    r = F.col("o3") / F.col("open") - 1
    return x.select("sym", "day", F.round(r, 6).alias("ret"), F.round(r - F.col("rm"), 6).alias("excess"))


@query(
    using("filings")
    + f""", k as (select * from filings where filed < date '{CUTOFF}') select series, period_end, last(val order by filed, fact_id) as val, min(filed) as first_filed, max(filed) as last_filed, count(*) as versions from k group by 1, 2"""
)
def latest_filed_value(spark: SparkSession, folder: str) -> DataFrame:
    """Of each period the value filed last before the cutoff day, and when it first became known."""
    x = filings(spark, folder).where(F.col("filed") < F.lit(CUTOFF).cast("date"))
    return x.groupBy("series", "period_end").agg(F.max_by("val", F.struct("filed", "fact_id")).alias("val"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"), F.count("*").alias("versions"))


_KNOWN = f", k as (select series, period_end, last(val order by filed, fact_id) as val from filings where filed < date '{CUTOFF}' group by 1, 2)"


def _known(spark: SparkSession, folder: str) -> DataFrame:
    x = filings(spark, folder).where(F.col("filed") < F.lit(CUTOFF).cast("date"))
    return x.groupBy("series", "period_end").agg(F.max_by("val", F.struct("filed", "fact_id")).alias("val"))


@query(
    using("filings") + _KNOWN
    + """, y as (select a.series, a.period_end, a.val, b.val as prior, row_number() over (partition by a.series, a.period_end order by abs(a.period_end - b.period_end - 365), b.period_end) as n from k a left join k b on b.series = a.series and b.period_end between a.period_end - 390 and a.period_end - 340)
select series, period_end, round(val, 2) as val, round(prior, 2) as prior, case when abs(prior) > 1e-9 then round(least(greatest((val - prior) / abs(prior), -1), 3), 6) end as growth from y where n = 1"""
)
def year_over_year(spark: SparkSession, folder: str) -> DataFrame:
    """Each quarter with the one a year before, 25 days about, the nearest if there are several: a band join on the entity and the year.

    As known on the one day CUTOFF: facts filed from then on are not read, which is what the cutoff is for.
    """
    a = _known(spark, folder)
    # candidates by month cells, so that the band is an equality join
    cell = lambda d: F.floor(F.unix_date(d) / 64)
    b = a.select(F.col("series").alias("_c"), F.col("period_end").alias("_e"), F.col("val").alias("prior"), cell(F.col("period_end")).alias("_cell"))
    x = a.withColumn("_want", F.date_sub("period_end", 365)).withColumn("_at", F.explode(F.sequence(cell(F.date_sub("period_end", 390)), cell(F.date_sub("period_end", 340)))))
    hit = (F.col("series") == F.col("_c")) & (F.col("_at") == F.col("_cell")) & (F.abs(F.datediff("_want", "_e")) <= 25)
    x = x.join(b, hit, "left").groupBy("series", "period_end", "val").agg(F.min_by("prior", F.when(F.col("_e").isNotNull(), F.struct(F.abs(F.datediff("_want", "_e")), F.col("_e")))).alias("prior"))
    growth = F.when(F.abs("prior") > 1e-9, F.round(clip((F.col("val") - F.col("prior")) / F.abs("prior"), -1, 3), 6))
    return x.select("series", "period_end", F.round("val", 2).alias("val"), F.round("prior", 2).alias("prior"), growth.alias("growth"))


@query(
    using("filings") + _KNOWN
    + """, c as (select series, period_end, val - lag(val, 4) over (partition by series order by period_end) as ch from k), h as (select *, stddev_pop(ch) over w as sd, count(ch) over w as n from c window w as (partition by series order by period_end rows between 8 preceding and 1 preceding))
select series, period_end, case when sd > 1e-9 then round(least(greatest(ch / sd, -5), 5), 4) end as sue from h where ch is not null and n >= 4"""
)
def seasonal_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """The change on four quarters before, in deviations of the eight such changes before it.

    As known on the one day CUTOFF: facts filed from then on are not read, which is what the cutoff is for.
    """
    w = W.partitionBy("series").orderBy("period_end")
    x = _known(spark, folder).select("series", "period_end", (F.col("val") - F.lag("val", 4).over(w)).alias("ch"))
    h = w.rowsBetween(-8, -1)
    x = x.select("*", F.stddev_pop("ch").over(h).alias("sd"), F.count("ch").over(h).alias("n")).where("ch is not null and n >= 4")
    return x.select("series", "period_end", F.when(F.col("sd") > 1e-9, F.round(clip(F.col("ch") / F.col("sd"), -5, 5), 4)).alias("sue"))


@query(
    using("filings") + _KNOWN
    + """, t as (select series, period_end, sum(val) over w as ttm, count(*) over w as n, period_end - lag(period_end, 3) over (partition by series order by period_end) as span, max(gap) over w as gap from (select *, coalesce(period_end - lag(period_end) over (partition by series order by period_end), 0) as gap from k) window w as (partition by series order by period_end rows 3 preceding))
select series, period_end, round(ttm, 2) as ttm from t where n = 4 and span < 300"""
)
def trailing_year(spark: SparkSession, folder: str) -> DataFrame:
    """The sum of four quarters that follow each other without a gap.

    As known on the one day CUTOFF: facts filed from then on are not read, which is what the cutoff is for.
    """
    w = W.partitionBy("series").orderBy("period_end")
    x = _known(spark, folder).select("series", "period_end", F.sum("val").over(w.rowsBetween(-3, 0)).alias("ttm"), F.count("*").over(w.rowsBetween(-3, 0)).alias("n"), F.datediff("period_end", F.lag("period_end", 3).over(w)).alias("span"))
    return x.where("n = 4 and span < 300").select("series", "period_end", F.round("ttm", 2).alias("ttm"))


@query(
    """with q as (select distinct fact_id, cik, source, period_end, value, first_filed from quarters), g as (select *, case when period_end - lag(period_end) over (partition by cik order by period_end, first_filed, fact_id) <= 20 then 0 else 1 end as new from q),
i as (select *, sum(new) over (partition by cik order by period_end, first_filed, fact_id) as island from g) select cik, last(period_end order by first_filed, fact_id) as period_end, last(fact_id order by first_filed, fact_id) as fact_id, count(*) as n from i group by cik, island"""
)
def merged_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose period ends lie within 20 days of each other are one period; the last filed stands for it. Facts of one day are counted before the window."""
    last = F.struct("first_filed", "fact_id", "period_end")
    x = table(spark, folder, "quarters").select("fact_id", "cik", "source", "period_end", "value", "first_filed").distinct()
    x = x.groupBy("cik", "period_end").agg(F.max(last).alias("last"), F.count("*").alias("n"))
    w = W.partitionBy("cik").orderBy("period_end")
    x = x.withColumn("new", F.when(F.datediff("period_end", F.lag("period_end").over(w)) <= 20, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    y = x.groupBy("cik", "island").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    return y.select("cik", "last.period_end", "last.fact_id", "n")


@query(
    using("preds")
    + """, a as (select run_id, sym, made, p from preds), b as (select a.run_id, count(b.run_id) as n, avg(b.p) as mp from a left join a b on b.sym = a.sym and b.made < a.made and b.made >= a.made - 90 group by a.run_id) select run_id, n, round(mp, 11) as mean_p from b"""
)
def earlier_within(spark: SparkSession, folder: str) -> DataFrame:
    """Each prediction with the number and mean of those on the same symbol in the 90 days before it: a range frame, not a join.

    A symbol's rows lie in slots of 90 days, its own and the next one's, so that a frame never reaches beyond a slot and a hot symbol spreads over them.
    """
    day = F.unix_date("made")
    own = F.floor(day / 90)
    x = preds(spark, folder).select("run_id", "sym", day.alias("d"), "p", own.alias("own"), F.explode(F.array(own, own + 1)).alias("slot"))
    w = W.partitionBy("sym", "slot").orderBy("d").rangeBetween(-90, -1)
    return x.select("run_id", F.count("p").over(w).alias("n"), F.round(F.avg("p").over(w), 11).alias("mean_p"), (F.col("slot") == F.col("own")).alias("_own")).where("_own").drop("_own")


@query(
    """select e.ticker, count(*) as n, count(*) filter (where r.late) as late, round(avg(case when r.late then 1.0 else 0.0 end), 6) as share from (select distinct evidence_id, ticker, retrieved_at from evidence_refs where ticker is not null) e
join (select distinct evidence_id, hour(retrieved_at) >= 21 as late from evidence_refs) r using (evidence_id) group by e.ticker"""
)
def late_share(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that came after the day's deadline of 21:00 UTC, by ticker; late rows are counted, not dropped."""
    x = table(spark, folder, "evidence_refs").select("evidence_id", "ticker", "retrieved_at").where("ticker is not null").distinct().withColumn("late", (F.hour("retrieved_at") >= 21).cast("double"))
    return x.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("late").cast("bigint").alias("late"), F.round(F.avg("late"), 6).alias("share"))


def _every_day(x: DataFrame) -> DataFrame:
    """All days from the first to the last of x."""
    return x.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))


@query(
    using("px_d")
    + """, b as (select min(day) as a, max(day) as z from px_d), c as (select cast(d.day as date) as day from b, generate_series(cast(b.a as timestamp), cast(b.z as timestamp), interval 1 day) d(day)) select c.day, round(m.close, 9) as close, m.day as from_day from c asof left join px_d m on c.day >= m.day"""
)
def forward_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every calendar day with the last close there was: calendar join and forward fill."""
    x = px_d(spark, folder)
    m = x.select(F.col("day").alias("t"), F.col("day").alias("from_day"), F.round("close", 9).alias("close"), F.lit(0).alias("k"))
    return asof_join(_every_day(x).withColumn("k", F.lit(0)), m, ["k"], "day", "t", ["close", "from_day"]).select("day", "close", "from_day")


@query(
    """with t as (select ticker, cast(timestamp as date) as day from bars group by 1, 2), b as (select ticker, min(day) as a, max(day) as z from t group by 1), c as (select b.ticker, cast(d.day as date) as day from b, generate_series(cast(b.a as timestamp), cast(b.z as timestamp), interval 1 day) d(day) where isodow(d.day) <= 5)
select c.ticker, c.day from c anti join t on t.ticker = c.ticker and t.day = c.day"""
)
def missing_weekdays(spark: SparkSession, folder: str) -> DataFrame:
    """Weekdays without a bar between a series' first and last: an anti join with each series' own calendar."""
    t = table(spark, folder, "bars").select("ticker", F.col("timestamp").cast("date").alias("day")).distinct()
    c = t.groupBy("ticker").agg(F.min("day").alias("a"), F.max("day").alias("z")).select("ticker", F.explode(F.sequence("a", "z")).alias("day")).where(F.weekday("day") < 5)
    return c.join(t, ["ticker", "day"], "left_anti")


@query(
    using("px_d")
    + """ select cast(date_trunc('month', day) as date) as month, min(day) as first_day, max(day) as last_day, min(day) filter (where day >= cast(date_trunc('month', day) as date) + 14) as first_after_15, count(*) as n,
  cast(date_trunc('month', day) as date) + cast((5 - isodow(date_trunc('month', day)) + 7) % 7 as int) + 14 as third_friday from px_d group by 1, 6"""
)
def month_days(spark: SparkSession, folder: str) -> DataFrame:
    """First, last and mid-month trading days, and the third Friday."""
    from pitlake.functions.columns import third_friday

    month = F.trunc("day", "month")
    return px_d(spark, folder).groupBy(month.alias("month"), third_friday(F.col("day")).alias("third_friday")).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min(F.when(F.dayofmonth("day") >= 15, F.col("day"))).alias("first_after_15"), F.count("*").alias("n")
    )


@query(
    using("preds")
    + """, s as (select *, row_number() over (partition by arm order by made, run_id) as k, count(*) over (partition by arm) as n from preds), h as (select arm, k > n * 2 / 3.0 as holdout, count(*) as n, avg(case when (p > 0.5) = up then 1.0 else 0.0 end) as acc, sum(p * ret) as spr, sum(p * p) as spp from s group by 1, 2)
select arm, holdout, n, round(acc, 6) as accuracy, round(spr / spp, 6) as slope from h"""
)
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    """Older two thirds against the newer third of each arm, by time and then id.

    The day in which an arm's two thirds end is found by counting days, so that only the rows of that one day are numbered; all others are older or newer as
    their day is.
    """
    x = preds(spark, folder).select("arm", "run_id", "made", "p", "up", "ret")
    days = x.groupBy("arm", "made").agg(F.count("*").alias("c"))
    w = W.partitionBy("arm")
    days = days.select("arm", "made", (F.sum("c").over(w.orderBy("made")) - F.col("c")).alias("before"), F.col("c"), F.sum("c").over(w).alias("total"))
    limit = F.col("total") * 2 / 3
    days = days.select(F.col("arm").alias("_a"), F.col("made").alias("_m"), F.when(F.col("before") + F.col("c") <= limit, False).when(F.col("before") >= limit, True).alias("side"), (limit - F.col("before")).alias("left"))
    x = x.join(days, (F.col("arm") == F.col("_a")) & (F.col("made") == F.col("_m")))
    edge = x.where("side is null").withColumn("side", F.row_number().over(W.partitionBy("arm").orderBy("run_id")) > F.col("left"))
    x = x.where("side is not null").unionByName(edge)
    return x.groupBy("arm", F.col("side").alias("holdout")).agg(
        F.count("*").alias("n"), F.round(F.avg(((F.col("p") > 0.5) == F.col("up")).cast("double")), 6).alias("accuracy"), F.round(div(F.sum(F.col("p") * F.col("ret")), F.sum(F.col("p") * F.col("p"))), 6).alias("slope")
    )

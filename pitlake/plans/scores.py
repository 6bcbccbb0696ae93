"""Forecast scores over the predictions: accuracy, calibration, rank correlation, gaps between arms, resampled intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import average_rank, clip, correlation, div, normal_cdf, percent_of
from pitlake.functions.quantiles import exact_quantiles
from pitlake.plans.registry import query
from pitlake.plans.views import preds, using

#: Predictions of a month that a cross-sectional score needs.
NAMES = 10
#: Probabilities have four digits, so they are whole numbers of 1 / UNITS.
UNITS = 10_000


def _hit() -> F.Column:
    return ((F.col("p") > 0.5) == F.col("up")).cast("double")


def _brier() -> F.Column:
    return F.pow(F.col("p") - F.col("up").cast("double"), 2)


def _log_loss() -> F.Column:
    return -F.when(F.col("up"), F.log("p")).otherwise(F.log(1 - F.col("p")))


def _six_digits(x: F.Column) -> F.Column:
    """x rounded as SQL does, which scales first: 41 / 640 becomes 0.064062, where F.round gives 0.064063."""
    return F.round(x * 1e6) / 1e6


@query(
    using("preds")
    + """, w as (select arm, cutoff, avg(sign(p - 0.5) * ret) filter (where p <> 0.5) as ls from preds group by arm, cutoff), v as (select arm, avg(ls) as m, stddev_samp(ls) as s, count(ls) as k from w group by arm),
a as (select arm, count(*) as n, avg(case when (p > 0.5) = up then 1.0 else 0.0 end) as acc, avg(case when p > 0.5 then 1.0 else 0.0 end) as calls, avg(pow(p - case when up then 1 else 0 end, 2)) as brier, sum(-ln(case when up then p else 1 - p end)) filter (where p > 0 and p < 1) / count(*) as ll, avg(case when up then 1.0 else 0.0 end) as base, avg(p) as mp from preds group by arm)
select arm, n, round(acc, 6) as accuracy, round(calls, 6) as up_calls, round(brier, 6) as brier, round(ll, 6) as log_loss, round((acc - 0.5) * sqrt(n) / 0.5, 4) as z, round(base, 6) as base, round(mp, 6) as mean_p, round(m, 6) as ls_mean, round(m / nullif(s, 0), 4) as ls_sharpe, k as cutoffs from a join v using (arm)"""
)
def forecast_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Of each arm: accuracy, Brier and log loss, distance from a coin flip, and the long-short return by cutoff. Two aggregations, the second over cutoffs."""
    x = preds(spark, folder)
    ls = x.groupBy("arm", "cutoff").agg(F.avg(F.when(F.col("p") != 0.5, F.signum(F.col("p") - 0.5) * F.col("ret"))).alias("ls"))
    v = ls.groupBy("arm").agg(F.avg("ls").alias("m"), F.stddev_samp("ls").alias("s"), F.count("ls").alias("cutoffs"))
    a = x.groupBy("arm").agg(
        F.count("*").alias("n"), F.avg(_hit()).alias("acc"), F.avg((F.col("p") > 0.5).cast("double")).alias("calls"), F.avg(_brier()).alias("brier"),
        (F.sum(F.when((F.col("p") > 0) & (F.col("p") < 1), _log_loss())) / F.count("*")).alias("ll"), F.avg(F.col("up").cast("double")).alias("base"), F.avg("p").alias("mp"),
    )
    return a.join(v, "arm").select(
        "arm", "n", F.round("acc", 6).alias("accuracy"), F.round("calls", 6).alias("up_calls"), F.round("brier", 6).alias("brier"), F.round("ll", 6).alias("log_loss"), F.round((F.col("acc") - 0.5) * F.sqrt("n") / 0.5, 4).alias("z"),
        F.round("base", 6).alias("base"), F.round("mp", 6).alias("mean_p"), F.round("m", 6).alias("ls_mean"), F.round(div(F.col("m"), F.col("s")), 4).alias("ls_sharpe"), "cutoffs",
    )


@query(
    using("preds")
    + """, w as (select arm, cutoff, count(*) as n, avg(case when (p > 0.5) = up then 1.0 else 0.0 end) as acc, sum(case when (p > 0.5) = up then 1 else 0 end) as hits, avg(pow(p - case when up then 1 else 0 end, 2)) as brier from preds group by arm, cutoff)
select arm, cutoff, n, round(acc, 6) as accuracy, round(brier, 6) as brier, round(cast(sum(hits) over w as double) / sum(n) over w, 6) as accuracy_so_far from w window w as (partition by arm order by cutoff)"""
)
def scores_over_time(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and Brier score by arm and cutoff, with the expanding accuracy."""
    w = W.partitionBy("arm").orderBy("cutoff")
    x = preds(spark, folder).groupBy("arm", "cutoff").agg(F.count("*").alias("n"), F.sum(_hit()).alias("hits"), F.avg(_brier()).alias("brier"))
    return x.select("arm", "cutoff", "n", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"), F.round("brier", 6).alias("brier"), F.round(F.sum("hits").over(w) / F.sum("n").over(w), 6).alias("accuracy_so_far"))


@query(
    using("preds")
    + """, e as (select k, k / 10.0 as lo, (k + 1) / 10.0 as hi from range(10) t(k)) select arm, cast(k as int) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(case when up then 1.0 else 0.0 end), 6) as realised from preds join e on (p > lo or (k = 0 and p = 0)) and p <= hi group by arm, k"""
)
def calibration_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Mean probability against what happened, in ten bins closed on the right, the lowest on both sides. Sums are of whole numbers, so that a mean halfway between two roundings doesn't hang on the order of rows."""
    edges = F.array(*[F.lit(k / 10) for k in range(1, 10)])
    x = preds(spark, folder).where("p between 0 and 1").withColumn("bin", F.size(F.filter(edges, lambda e: F.col("p") > e)))
    n, units = F.count("*"), F.sum(F.round(F.col("p") * UNITS).cast("bigint"))
    return x.groupBy("arm", "bin").agg(n.alias("n"), _six_digits(units / (n * UNITS)).alias("mean_p"), _six_digits(F.avg(F.col("up").cast("double"))).alias("realised"))


_RANKED = """, k as (select arm, cutoff, sym, run_id, p, ret, count(*) over (partition by arm, cutoff) as n, rank() over (partition by arm, cutoff order by p) + (count(*) over (partition by arm, cutoff, p) - 1) / 2.0 as rp, rank() over (partition by arm, cutoff order by ret) + (count(*) over (partition by arm, cutoff, ret) - 1) / 2.0 as rr from preds),
ic as (select arm, cutoff, n, corr(rp, rr) as ic from k where n >= 10 group by arm, cutoff, n having min(p) < max(p) and min(ret) < max(ret))"""


def _ics(spark: SparkSession, folder: str, names: int = NAMES) -> DataFrame:
    x = preds(spark, folder).select("arm", "cutoff", F.count("*").over(W.partitionBy("arm", "cutoff")).alias("n"), average_rank("p", "arm", "cutoff").alias("rp"), average_rank("ret", "arm", "cutoff").alias("rr"))
    return x.where(F.col("n") >= names).groupBy("arm", "cutoff", "n").agg(correlation("rp", "rr").alias("ic")).where("ic is not null")


@query(using("preds") + _RANKED + " select arm, cutoff, n, round(ic, 6) as ic from ic")
def rank_ic_by_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of forecast and outcome by arm and cutoff; cutoffs with few names or a constant side have none."""
    return _ics(spark, folder).select("arm", "cutoff", "n", F.round("ic", 6).alias("ic"))


@query(
    using("preds")
    + """, q as (select arm, cutoff, ret, count(*) over (partition by arm, cutoff) as n, (rank() over (partition by arm, cutoff order by p) + (count(*) over (partition by arm, cutoff, p) - 1) / 2.0) / count(*) over (partition by arm, cutoff) as q,
  row_number() over (partition by arm, cutoff order by p, sym, run_id) as lo, row_number() over (partition by arm, cutoff order by p desc, sym desc, run_id desc) as hi from preds)
select arm, cutoff, n, round(avg(ret) filter (where q > 0.8) - avg(ret) filter (where q <= 0.2), 13) as by_rank, round(avg(ret) filter (where hi <= greatest(1, n // 5)) - avg(ret) filter (where lo <= greatest(1, n // 5)), 13) as by_place from q where n >= 10 group by arm, cutoff, n"""
)
def quintile_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of the top fifth less that of the bottom fifth: by percent rank, ties together, and by place, in a total order."""
    w = W.partitionBy("arm", "cutoff")
    x = preds(spark, folder).select(
        "arm", "cutoff", "ret", F.count("*").over(w).alias("n"), percent_of("p", "arm", "cutoff").alias("q"), F.row_number().over(w.orderBy("p", "sym", "run_id")).alias("lo"), F.row_number().over(w.orderBy(F.desc("p"), F.desc("sym"), F.desc("run_id"))).alias("hi")
    ).where(F.col("n") >= NAMES)
    k, mean = F.greatest(F.lit(1), F.floor(F.col("n") / 5)), lambda c: F.avg(F.when(c, F.col("ret")))
    return x.groupBy("arm", "cutoff", "n").agg(F.round(mean(F.col("q") > 0.8) - mean(F.col("q") <= 0.2), 13).alias("by_rank"), F.round(mean(F.col("hi") <= k) - mean(F.col("lo") <= k), 13).alias("by_place"))


@query(using("preds") + _RANKED + " select a.arm as arm, b.arm as other, count(*) as cutoffs, round(avg(a.ic - b.ic), 6) as gap from ic a join ic b on a.cutoff = b.cutoff and a.arm < b.arm group by 1, 2")
def paired_ic_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Mean gap in rank correlation between arms over the cutoffs both have."""
    a = _ics(spark, folder)
    b = a.select(F.col("arm").alias("other"), "cutoff", F.col("ic").alias("ic2"))
    return a.join(b, "cutoff").where("arm < other").groupBy("arm", "other").agg(F.count("*").alias("cutoffs"), F.round(F.avg(F.col("ic") - F.col("ic2")), 6).alias("gap"))


@query(
    using("preds")
    + """, b as (select arm, cutoff, sum(pow(p - case when up then 1 else 0 end, 2)) as s, count(*) as n from preds group by arm, cutoff) select x.arm, y.arm as other, count(*) as cutoffs, round(sum(x.s) / sum(x.n) - sum(y.s) / sum(y.n), 6) as gap from b x join b y on x.cutoff = y.cutoff and x.arm < y.arm group by 1, 2"""
)
def brier_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Gap in Brier score between arms as a ratio of sums over common cutoffs: cutoffs are aggregated first, then joined."""
    a = preds(spark, folder).groupBy("arm", "cutoff").agg(F.sum(_brier()).alias("s"), F.count("*").alias("n"))
    b = a.select(F.col("arm").alias("other"), "cutoff", F.col("s").alias("s2"), F.col("n").alias("n2"))
    return a.join(b, "cutoff").where("arm < other").groupBy("arm", "other").agg(F.count("*").alias("cutoffs"), F.round(F.sum("s") / F.sum("n") - F.sum("s2") / F.sum("n2"), 6).alias("gap"))


@query(using("preds") + " select arm, cutoff, round(avg(sign(p - 0.5) * ret), 13) as ls from preds where p <> 0.5 group by arm, cutoff")
def weekly_long_short(spark: SparkSession, folder: str) -> DataFrame:
    """Equal-weight long-short return by the sign of each call."""
    return preds(spark, folder).where("p <> 0.5").groupBy("arm", "cutoff").agg(F.round(F.avg(F.signum(F.col("p") - 0.5) * F.col("ret")), 13).alias("ls"))


@query(
    using("preds")
    + """, c as (select distinct cutoff from preds), d as (select resolve_date as day, count(*) as n, sum(case when up then 1 else 0 end) as ups from preds group by 1)
select cutoff, cast(coalesce(sum(n), 0) as bigint) as known, round(least(greatest(sum(ups) / sum(n), 0.05), 0.95), 6) as rate from c join d on d.day <= c.cutoff group by cutoff"""
)
def resolved_base_rate(spark: SparkSession, folder: str) -> DataFrame:
    """At each cutoff the share of rises among predictions resolved by then: day totals, running sums, as-of lookup, no join of rows with rows."""
    x = preds(spark, folder)
    days = x.groupBy(F.col("resolve_date").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("up").cast("int")).alias("ups"))
    both = days.select("day", "n", "ups", F.lit(0).alias("ask")).unionByName(x.select(F.col("cutoff").alias("day")).distinct().select("day", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("ups"), F.lit(1).alias("ask")))
    w = W.partitionBy(F.lit(0)).orderBy("day", "ask").rowsBetween(W.unboundedPreceding, 0)  # one row for each calendar day
    both = both.select("day", "ask", F.sum("n").over(w).alias("known"), F.sum("ups").over(w).alias("ups")).where("ask = 1 and known > 0")
    return both.select(F.col("day").alias("cutoff"), "known", F.round(clip(F.col("ups") / F.col("known"), 0.05, 0.95), 6).alias("rate"))


@query(
    using("preds")
    + """, r as (select arm, resolve_date, run_id, pow(p - case when up then 1 else 0 end, 2) as b from preds), c as (select distinct cutoff from preds),
j as (select c.cutoff, r.arm, r.b from c join r on r.resolve_date <= c.cutoff qualify row_number() over (partition by c.cutoff, r.arm order by r.resolve_date desc, r.run_id) <= 100),
a as (select cutoff, arm, avg(b) as b, count(*) as n from j group by 1, 2 having count(*) >= 25) select cutoff, first(arm order by b, arm) as arm, round(min(b), 6) as brier from a group by cutoff"""
)
def selector_arm(spark: SparkSession, folder: str) -> DataFrame:
    """At each cutoff the arm with the best Brier score over its last 100 predictions resolved by then, of those with 25 or more.

    Each arm's rows are cut into slots of one resolve month, and of each slot only the last 100 can matter later; a cutoff reads its arm's slots back to the
    one that completes the 100. So no window runs over all rows of an arm: the largest is one arm's month, then 100 rows for each arm and month.
    """
    last, least = 100, 25
    x = preds(spark, folder).select("arm", "resolve_date", "run_id", _brier().alias("b"), F.trunc("resolve_date", "month").alias("slot"), "cutoff")
    r = x.withColumn("k", F.row_number().over(W.partitionBy("arm", "slot").orderBy(F.desc("resolve_date"), "run_id"))).where(F.col("k") <= last)
    per = x.groupBy("arm", "slot").agg(F.least(F.count("*"), F.lit(last)).alias("n"))
    w = W.partitionBy("arm").orderBy("slot")
    per = per.withColumn("upto", F.sum("n").over(w)).withColumnRenamed("arm", "_a").withColumnRenamed("slot", "_s")
    asks = x.select("cutoff").distinct()
    # cutoffs are month starts: what resolves on the cutoff's own day is the only part of its month that counts
    months = asks.select("cutoff").collect()  # bounded by the calendar
    known = per.withColumn("cutoff", F.explode(F.array(*[F.lit(m[0]) for m in months]))).where(F.col("_s") < F.col("cutoff")) if months else per.withColumn("cutoff", F.lit(None).cast("date")).limit(0)
    known = known.withColumn("after", F.max("upto").over(W.partitionBy("_a", "cutoff")) - F.col("upto")).where(F.col("after") < last)
    # on the first of a month, its own rows are ranked anew: the month's last 100 needn't hold them
    today = x.where("resolve_date = slot").select("arm", "b", "resolve_date", "run_id", F.col("slot").alias("cutoff")).join(asks, "cutoff", "left_semi")
    back = r.join(known.select("_a", "_s", F.col("cutoff").alias("_c")), (F.col("arm") == F.col("_a")) & (F.col("slot") == F.col("_s"))).select("arm", "b", "resolve_date", "run_id", F.col("_c").alias("cutoff"))
    both = back.unionByName(today).withColumn("k", F.row_number().over(W.partitionBy("arm", "cutoff").orderBy(F.desc("resolve_date"), "run_id"))).where(F.col("k") <= last)
    a = both.groupBy("arm", "cutoff").agg(F.avg("b").alias("b"), F.count("*").alias("n")).where(F.col("n") >= least)
    return a.groupBy("cutoff").agg(F.min_by("arm", F.struct("b", "arm")).alias("arm"), F.round(F.min("b"), 6).alias("brier"))


@query(
    using("preds")
    + """, s as (select *, 'r' || abs(h) % 7 as kind from preds) select arm, h, grouping(arm) as g_arm, grouping(h) as g_h, count(*) as n, round(avg(case when (p > 0.5) = up then 1.0 else 0.0 end), 6) as accuracy from s group by grouping sets ((), (arm), (h), (arm, h))"""
)
def grouping_sets_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy pooled, by arm, by horizon and by both, in one pass."""
    x = preds(spark, folder)
    sets = x.groupingSets([[], [x["arm"]], [x["h"]], [x["arm"], x["h"]]], "arm", "h")
    return sets.agg(F.grouping("arm").cast("bigint").alias("g_arm"), F.grouping("h").cast("bigint").alias("g_h"), F.count("*").alias("n"), F.round(F.avg(_hit()), 6).alias("accuracy"))


@query(
    using("preds")
    + """, e as (select quantile_cont(p, [""" + ", ".join(f"{k / 10}" for k in range(1, 10)) + """]) as q from preds) select cast(len(list_filter(q, lambda x: p > x)) as int) as decile, count(*) as n, round(avg(ret), 6) as mean_ret, round(avg(case when (p > 0.5) = up then 1.0 else 0.0 end), 6) as hit from preds, e group by 1"""
)
def decile_table(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes by decile of the forecast, with exact interpolated edges."""
    x = preds(spark, folder)
    ends = exact_quantiles(x, [], {"p": F.col("p")}, [k / 10 for k in range(1, 10)]).first()  # nine numbers
    edges = [ends[f"p_{k}"] for k in range(9)] if ends else []
    x = x.withColumn("decile", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda v: F.col("p") > v)))
    return x.groupBy("decile").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.avg(_hit()), 6).alias("hit"))


#: Draws of the arithmetic bootstrap; a fixed multiplier of a full-period generator takes the place of a seed.
DRAWS = 200
_DRAW = "(({d} * 7919 + {i} * 104729 + {d} * {i} * 31) % 1000003) % {n}"


@query(
    using("preds") + _RANKED
    + f""", s as (select arm, ic, row_number() over (partition by arm order by cutoff) - 1 as i, count(*) over (partition by arm) as n from ic),
d as (select s.arm, t.d, s.i, {_DRAW.format(d='t.d', i='s.i', n='s.n')} as j from s, range({DRAWS}) t(d)), m as (select d.arm, d.d, avg(s.ic) as m from d join s on s.arm = d.arm and s.i = d.j group by 1, 2)
select arm, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi from m group by arm"""
)
def bootstrap_ic(spark: SparkSession, folder: str) -> DataFrame:
    """A 95 % interval of the mean rank correlation, resampling whole cutoffs; draws are arithmetic, so that any engine makes the same.

    Only the cutoffs' statistics are resampled, never rows: months x draws.
    """
    w = W.partitionBy("arm")
    s = _ics(spark, folder).select("arm", "ic", (F.row_number().over(w.orderBy("cutoff")) - 1).cast("bigint").alias("i"), F.count("*").over(w).alias("n"))
    d = s.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).select("arm", "d", F.expr(_DRAW.format(d="cast(d as bigint)", i="i", n="n")).alias("j"))
    m = d.join(s.select(F.col("arm").alias("a"), F.col("i").alias("k"), "ic"), (F.col("arm") == F.col("a")) & (F.col("j") == F.col("k"))).groupBy("arm", "d").agg(F.avg("ic").alias("m"))
    return m.groupBy("arm").agg(F.round(F.percentile("m", 0.025), 6).alias("lo"), F.round(F.percentile("m", 0.975), 6).alias("hi"))


def _cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    upper = f"exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r} * {poly}"
    return f"case when {z} >= 0 then 1 - {upper} else {upper} end"


@query(
    using("preds")
    + """, w as (select arm, cutoff, avg(sign(p - 0.5) * ret) as r from preds where p <> 0.5 group by arm, cutoff), a as (select arm, avg(r) as mu, stddev_samp(r) as s, stddev_pop(r) as sp, count(*) as n from w group by arm),
m as (select w.arm, any_value(mu / s) as sr, any_value(n) as n, avg(pow((r - mu) / sp, 3)) as g1, avg(pow((r - mu) / sp, 4)) as k from w join a using (arm) group by w.arm), z as (select arm, n, sr, sr * sqrt(n - 1) / sqrt(1 - g1 * sr + (k - 1) / 4 * sr * sr) as z from m where n >= 3)
select arm, n, round(sr, 6) as sharpe, round(""" + _cdf_sql("z") + ", 5) as psr from z"
)
def probabilistic_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    """The probability that the true Sharpe ratio is above 0, given length, skewness and kurtosis."""
    w = preds(spark, folder).where("p <> 0.5").groupBy("arm", "cutoff").agg(F.avg(F.signum(F.col("p") - 0.5) * F.col("ret")).alias("r"))
    m = w.groupBy("arm").agg(F.count("*").alias("n"), div(F.avg("r"), F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("g1"), (F.kurtosis("r") + 3).alias("k")).where("n >= 3")
    z = F.col("sr") * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("g1") * F.col("sr") + (F.col("k") - 1) / 4 * F.col("sr") * F.col("sr"))
    return m.withColumn("z", z).select("arm", "n", F.round("sr", 6).alias("sharpe"), F.round(normal_cdf(F.col("z")), 5).alias("psr"))


@query(
    using("preds")
    + """, x as (select cutoff, p - 0.5 as a, (p - 0.5) * (case when arm = 'walkbox_utc' then 1 else 0 end) as b, ret as y from preds), g as (select cutoff, count(*) as n, sum(a) as sa, sum(b) as sb, sum(y) as sy, sum(a * a) as saa, sum(a * b) as sab, sum(b * b) as sbb, sum(a * y) as say, sum(b * y) as sby from x group by cutoff)
select cast(sum(n) as bigint) as n, count(*) as clusters, round(sum(sa), 6) as sa, round(sum(sb), 6) as sb, round(sum(sy), 6) as sy, round(sum(saa), 6) as saa, round(sum(sab), 6) as sab, round(sum(sbb), 6) as sbb, round(sum(say), 6) as say, round(sum(sby), 6) as sby from g"""
)
def normal_equations(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of a regression with interaction, by cluster then in all: what refits resample in place of rows."""
    a, b, y = F.col("a"), F.col("b"), F.col("ret")
    x = preds(spark, folder).withColumn("a", F.col("p") - 0.5).withColumn("b", F.col("a") * (F.col("arm") == "walkbox_utc").cast("int"))
    sums = {"sa": a, "sb": b, "sy": y, "saa": a * a, "sab": a * b, "sbb": b * b, "say": a * y, "sby": b * y}
    g = x.groupBy("cutoff").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])
    return g.agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), *[F.round(F.sum(k), 6).alias(k) for k in sums])

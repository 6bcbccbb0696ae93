"""Joins, aggregations, sorts and sets over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import average_rank, div, short_hash
from pitlake.functions.quantiles import exact_medians, exact_quantiles
from pitlake.plans.registry import query
from pitlake.plans.views import preds, using
from pitlake.sources.tables import table


def _t(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


@query("select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as base, round(avg(l_discount), 6) as disc, count(*) as n from lineitem where l_shipdate <= timestamp '2001-06-01' group by 1, 2")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Filter, group and aggregate; the filter is pushed to the scan and five columns are read."""
    x = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("bigint").alias("qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("base"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n")
    )


@query(
    """select n_name, cast(year(o_orderdate) as int) as year, cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(4,2))) as double) as revenue, count(distinct o_orderkey) as orders
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2"""
)
def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """A star join: facts with orders by key, dimensions after; the optimiser picks the strategies by size."""
    li, o, c, n = _t(spark, folder, "lineitem", "orders", "customer", "nation")
    revenue = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount")).cast("decimal(4,2)")
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return x.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.sum(revenue).cast("double").alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("select s.s_suppkey, s.s_nationkey, count(l.l_orderkey) as n from supplier s left join lineitem l on l.l_suppkey = s.s_suppkey and l.l_quantity > 45 group by 1, 2")
def left_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """A left join that keeps keys without a match; the right side is counted before the shuffle."""
    s, li = _t(spark, folder, "supplier", "lineitem")
    counts = li.where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("l_orderkey").alias("n"))
    return s.select("s_suppkey", "s_nationkey").join(counts, "s_suppkey", "left").select("s_suppkey", "s_nationkey", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("select c_custkey, c_nationkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a large order."""
    c, o = _t(spark, folder, "customer", "orders")
    return c.select("c_custkey", "c_nationkey").join(o.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an urgent order."""
    c, o = _t(spark, folder, "customer", "orders")
    return c.select("c_custkey", "c_nationkey").join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(
    """with e as (select user_id, event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2, 3) select user_id, day, coalesce(a.n, 0) as clicks, coalesce(b.n, 0) as views
from (select * from e where event_type = 'click') a full join (select * from e where event_type = 'view') b using (user_id, day)"""
)
def full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Two series aligned on user and day, zero where one is missing: one pass of conditional counts in place of a full join."""
    e = table(spark, folder, "events").where("event_type in ('click', 'view')")
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(kind("click").alias("clicks"), kind("view").alias("views"))


@query(
    """with d as (select distinct event_type, cast(ts as date) as day from events), k as (select count(distinct event_type) as k from events) select day from d group by day having count(*) = (select k from k)"""
)
def common_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which every type has an event."""
    e = table(spark, folder, "events").select("event_type", F.col("ts").cast("date").alias("day")).distinct()
    k = e.agg(F.count_distinct("event_type").alias("k"))
    return e.groupBy("day").agg(F.count("*").alias("c")).join(F.broadcast(k), F.col("c") == F.col("k")).select("day")  # one row


@query(
    """with s as (select event_id, user_id, ts from events where event_type = 'signup'), c as (select user_id, ts as cts, value from events where event_type = 'click')
select s.event_id, count(c.cts) as n, round(coalesce(sum(cast(c.value as decimal(18,4))), 0), 4)::double as total from s left join c on c.user_id = s.user_id and c.cts > s.ts and c.cts <= s.ts + interval 2 days group by 1"""
)
def interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks of the user in the two days after each signup: a range frame over both kinds, sorted once, in place of a join of intervals."""
    e = table(spark, folder, "events").where("event_type in ('signup', 'click')")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select("event_id", "user_id", "event_type", us.alias("us"), F.col("value").cast("decimal(18,4)").alias("v"))
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(1, 2 * 86_400_000_000)
    click = F.when(F.col("event_type") == "click", F.col("v"))
    x = e.select("event_id", "event_type", F.count(click).over(w).alias("n"), F.coalesce(F.sum(click).over(w), F.lit(0)).cast("double").alias("total"))
    return x.where("event_type = 'signup'").select("event_id", "n", "total")


@query(
    """with p as (select p_partkey, p_brand, p_size from part), k as (select a.p_brand, a.p_size as size, b.step from (select distinct p_brand, p_size from p) a cross join (select unnest([0.9, 1.0, 1.1]) as step) b)
select k.p_brand, k.size, cast(k.step as double) as step, count(p.p_partkey) as n from k left join p on p.p_brand = k.p_brand and p.p_size <= k.size * k.step group by 1, 2, 3"""
)
def cross_grid(spark: SparkSession, folder: str) -> DataFrame:
    """A grid of every brand and size with three steps, each counting the parts up to it; the grid comes from an array, not a cross join."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    sizes = p.groupBy("p_brand", F.col("p_size").alias("s")).agg(F.count("*").alias("k"))
    grid = sizes.select("p_brand", F.col("s").alias("size"), F.explode(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.1))).alias("step"))
    both = sizes.select("p_brand", F.col("s").cast("double").alias("at"), "k", F.lit(None).cast("int").alias("size"), F.lit(None).cast("double").alias("step")).unionByName(
        grid.select("p_brand", (F.col("size") * F.col("step")).alias("at"), F.lit(0).cast("bigint").alias("k"), F.col("size").cast("int").alias("size"), "step")
    )
    w = W.partitionBy("p_brand").orderBy("at")
    return both.select("p_brand", "size", "step", F.sum("k").over(w).alias("n")).where("step is not null").select("p_brand", F.col("size").cast(dict(p.dtypes)["p_size"]).alias("size"), "step", "n")


@query(
    using("preds")
    + """ select arm, cutoff, sym, p, place from (select *, row_number() over (partition by arm, cutoff order by p desc, sha256('7|' || cast(cutoff as varchar) || '|' || sym || '|' || run_id)) as place from preds) where place <= 3"""
)
def topk_seeded_ties(spark: SparkSession, folder: str) -> DataFrame:
    """The three highest forecasts of each arm and cutoff, ties in a seeded order that any engine can repeat."""
    tie = F.sha2(F.concat_ws("|", F.lit("7"), F.col("cutoff").cast("string"), "sym", "run_id"), 256)
    x = preds(spark, folder).withColumn("place", F.row_number().over(W.partitionBy("arm", "cutoff").orderBy(F.desc("p"), tie)).cast("bigint")).where("place <= 3")
    return x.select("arm", "cutoff", "sym", "p", "place")


@query(
    """with v as (select l_partkey, sum(cast(l_extendedprice as decimal(18,2))) as value from lineitem group by 1), k as (select p_brand, p_partkey, value, row_number() over (partition by p_brand order by value desc, p_partkey) as r from v join part on p_partkey = l_partkey),
b as (select * from k where r = 1) select p_brand, p_partkey, cast(value as double) as value, row_number() over (order by value desc, p_brand) as place from b qualify place <= 20"""
)
def universe_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The best part of each brand by traded value, then the first twenty of those: aggregate, one of each, then rank."""
    v = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"))
    x = v.join(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.max_by(F.struct("p_partkey", "value"), F.struct("value", -F.col("p_partkey"))).alias("b"))
    x = x.select("p_brand", "b.p_partkey", "b.value").orderBy(F.desc("value"), "p_brand").limit(20)  # a top-k report
    return x.select("p_brand", "p_partkey", F.col("value").cast("double").alias("value"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("value"), "p_brand")).cast("bigint").alias("place"))


@query("select event_id, value from (select event_id, value, row_number() over (order by value desc, event_id) as hi, row_number() over (order by value, event_id) as lo from events) where hi <= 5 or lo <= 5")
def extremes(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest and smallest values: two bounded heaps, no global sort."""
    e = table(spark, folder, "events").select("event_id", "value")
    return e.orderBy(F.desc("value"), "event_id").limit(5).unionByName(e.orderBy("value", "event_id").limit(5)).distinct()


@query("select distinct user_id from events where event_type = 'signup' union select distinct o_custkey from orders where o_totalprice > 450000")
def union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Union of two sets of ids."""
    e, o = _t(spark, folder, "events", "orders")
    return e.where("event_type = 'signup'").select("user_id").union(o.where("o_totalprice > 450000").select("o_custkey")).distinct()


@query("select user_id from events where event_type = 'signup' intersect select user_id from events where event_type = 'error'")
def intersection(spark: SparkSession, folder: str) -> DataFrame:
    """Users with both kinds of event: one pass with two flags."""
    e = table(spark, folder, "events")
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("a"), F.bool_or(F.col("event_type") == "error").alias("b")).where("a and b").select("user_id")


@query("select distinct ticker from issuers where ticker is not null except select ticker from evidence_refs")
def difference(spark: SparkSession, folder: str) -> DataFrame:
    """Issuers that no evidence names."""
    i, e = _t(spark, folder, "issuers", "evidence_refs")
    return i.select("ticker").where("ticker is not null").distinct().join(e.select("ticker"), "ticker", "left_anti")


@query(
    """with u as (select distinct evidence_id, ticker, source_type, data_quality_score from evidence_refs) select evidence_id, ticker, source_type from u qualify row_number() over (partition by ticker, source_type order by data_quality_score desc, evidence_id) = 1"""
)
def dedup_keep_best(spark: SparkSession, folder: str) -> DataFrame:
    """One piece of evidence for each ticker and kind, the best scored, then the smallest id: an aggregate, which combines before the shuffle."""
    u = table(spark, folder, "evidence_refs").select("evidence_id", "ticker", "source_type", "data_quality_score")
    x = u.groupBy("ticker", "source_type").agg(F.min(F.struct(-F.col("data_quality_score"), F.col("evidence_id"))).alias("b"))
    return x.select(F.col("b.evidence_id").alias("evidence_id"), "ticker", "source_type")


@query(
    """with s as (select l_orderkey, list_sort(list(distinct l_suppkey)) as s from lineitem group by 1) select cast(len(s) as int) as size, count(*) as n, count(distinct s) as sets from s group by 1"""
)
def canonical_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of suppliers by order, in canonical form, counted by size."""
    s = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return s.groupBy(F.size("s").alias("size")).agg(F.count("*").alias("n"), F.count_distinct(F.array_join("s", ",")).alias("sets"))


@query(
    """with d as (select distinct seq, type, cohort, source, logodds, ticker from ledger) select cohort, count(*) filter (where type = 'decision') as decisions, count(*) filter (where type = 'missed') as missed, count(*) filter (where type = 'outcome') as outcomes,
  count(distinct ticker) as names, round(median(logodds) filter (where isfinite(logodds)), 6) + 0.0 as mid from d group by cohort"""
)
def ledger_scoreboard(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by kind of each cohort, distinct names and the median score. Repeated rows count once."""
    d = table(spark, folder, "ledger").select("seq", "type", "cohort", "logodds", "ticker").distinct()
    kind = lambda k: F.count(F.when(F.col("type") == k, 1))
    a = d.groupBy("cohort").agg(kind("decision").alias("decisions"), kind("missed").alias("missed"), kind("outcome").alias("outcomes"), F.count_distinct("ticker").alias("names"))
    m = exact_medians(d.withColumn("logodds", F.when(F.abs("logodds") < float("inf"), F.col("logodds"))), "cohort", "logodds", "mid").select(F.col("cohort").alias("_c"), (F.round("mid", 6) + 0.0).alias("mid"))
    return a.join(m, a["cohort"].eqNullSafe(m["_c"]), "left").drop("_c")


@query(
    """with q as (select source, cik, period_end, max(value) as v from quarters where value > 0 group by 1, 2, 3), x as (select a.source as a, b.source as b, a.v as va, b.v as vb from q a join q b on a.cik = b.cik and a.period_end = b.period_end and a.source < b.source),
y as (select a, b, va, vb, log10(va / vb) - round(log10(va / vb) / 3) * 3 as d from x) select a, b, count(*) as n, round(median(abs(d)), 6) as mid, round(max(abs(d)), 6) as worst, round(avg(case when abs(d) <= 0.01 then 1.0 else 0.0 end), 6) as same, round(corr(ln(va), ln(vb)), 6) as r from y group by 1, 2"""
)
def source_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How far every two sources differ on the periods that both have, in decades beside whole thousands: one row for each source is made first, then its periods meet."""
    from pitlake.functions.columns import correlation

    q = table(spark, folder, "quarters").where("value > 0 and source is not null").groupBy("source", "cik", "period_end").agg(F.max("value").alias("v"))
    # the sources of a period are few; each pair of them is a row
    s = q.groupBy("cik", "period_end").agg(F.collect_list(F.struct("source", "v")).alias("s"))
    x = s.select(F.explode("s").alias("x"), "s").select(F.col("x.source").alias("a"), F.col("x.v").alias("va"), F.explode(F.filter("s", lambda y: y["source"] > F.col("x.source"))).alias("y")).select("a", "va", F.col("y.source").alias("b"), F.col("y.v").alias("vb"))
    step = F.log10(F.col("va") / F.col("vb"))
    x = x.select("a", "b", F.log("va").alias("la"), F.log("vb").alias("lb"), F.abs(step - F.round(step / 3) * 3).alias("d"))
    mid = exact_quantiles(x, ["a", "b"], {"mid": F.col("d")}).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "mid")
    y = x.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("d").alias("worst"), F.avg((F.col("d") <= 0.01).cast("double")).alias("same"), correlation("la", "lb").alias("r"))
    return y.join(mid, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("mid", "worst", "same", "r")])


@query("select round(avg(case when k > 1 then 1.0 else 0.0 end), 6) as share, max(k) as most from (select count(*) over (partition by cast(ts as date), value) as k from events)")
def tie_share(spark: SparkSession, folder: str) -> DataFrame:
    """The share of values that occur twice or more on a day."""
    k = table(spark, folder, "events").groupBy(F.col("ts").cast("date").alias("day"), "value").agg(F.count("*").alias("k"))
    return k.agg(F.round(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k"), 6).alias("share"), F.max("k").alias("most"))


@query(
    """with v as (select user_id, cast(ts as date) as day, cast(sum(cast(value as decimal(18,4))) as double) as v from events group by 1, 2), r as (select day, user_id, rank() over (partition by day order by v) + (count(*) over (partition by day, v) - 1) / 2.0 as rk, count(*) over (partition by day) as n from v)
select day, user_id, cast(rk as double) as rk, round(rk / n, 6) as pct from r"""
)
def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks with ties at the mean of their places."""
    v = table(spark, folder, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    return v.select("day", "user_id", average_rank("v", "day").cast("double").alias("rk"), F.round(div(average_rank("v", "day"), F.count("*").over(W.partitionBy("day"))), 6).alias("pct"))


@query(
    """with q as (select distinct claim_id, made_by, verification_status, is_numeric from claims) select made_by, verification_status, grouping(made_by) as g1, grouping(verification_status) as g2, count(*) as n, count(*) filter (where is_numeric) as numeric_claims from q group by cube (made_by, verification_status)"""
)
def claims_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Claims by author and status, in every combination of the two."""
    q = table(spark, folder, "claims").select("claim_id", "made_by", "verification_status", "is_numeric").distinct()
    return q.cube("made_by", "verification_status").agg(F.grouping("made_by").cast("bigint").alias("g1"), F.grouping("verification_status").cast("bigint").alias("g2"), F.count("*").alias("n"), F.count(F.when(F.col("is_numeric"), 1)).alias("numeric_claims"))


@query("select evidence_id, substring(sha256('ev:' || source_type || ':' || evidence_id), 1, 24) as short, md5(evidence_id) as m from (select distinct evidence_id, source_type from evidence_refs)")
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids by hashing the fields that make a record what it is."""
    x = table(spark, folder, "evidence_refs").select("evidence_id", "source_type").distinct()
    return x.select("evidence_id", short_hash(F.lit("ev"), F.col("source_type"), F.col("evidence_id")).alias("short"), F.md5("evidence_id").alias("m"))


@query(
    """with b as (select ticker, feed, avg(q) as q, count(*) as n from (select distinct evidence_id, ticker, feed, cast(data_quality_score as decimal(6,3)) as q from evidence_refs where ticker is not null) group by 1, 2)
select ticker, first(feed order by q desc, feed) as best_feed, round(max(q), 6) as q, cast(sum(n) as bigint) as n from b group by ticker"""
)
def best_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """The feed with the highest mean quality for each ticker."""
    x = table(spark, folder, "evidence_refs").where("ticker is not null").select("evidence_id", "ticker", "feed", F.col("data_quality_score").cast("decimal(6,3)").alias("q")).distinct()
    b = x.groupBy("ticker", "feed").agg((F.sum("q").cast("double") / F.count("q")).alias("q"), F.count("*").alias("n"))
    return b.groupBy("ticker").agg(F.min_by("feed", F.struct(-F.col("q"), F.col("feed"))).alias("best_feed"), F.round(F.max("q"), 6).alias("q"), F.sum("n").alias("n"))


@query(
    """with x as (select s_nationkey as sym, cast(date_trunc('month', l_shipdate) as date) as m, cast(sum(l_quantity) as double) as q from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)
select a.sym as a, b.sym as b, count(*) as n, round(corr(a.q, b.q), 6) as r, round(covar_samp(a.q, b.q), 3) as c from x a join x b on a.m = b.m and a.sym <= b.sym group by 1, 2 having count(*) > 2 and stddev_samp(a.q) > 0 and stddev_samp(b.q) > 0"""
)
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation and covariance of the monthly quantities of all pairs of nations: the matrix asked for, over series that are aggregated first."""
    from pitlake.functions.columns import correlation

    li, s = _t(spark, folder, "lineitem", "supplier")
    x = li.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("a"), F.trunc("l_shipdate", "month").alias("m")).agg(F.sum("l_quantity").cast("double").alias("qa"))
    y = x.select(F.col("a").alias("b"), "m", F.col("qa").alias("qb"))
    return x.join(y, "m").where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(correlation("qa", "qb"), 6).alias("r"), F.round(F.covar_samp("qa", "qb"), 3).alias("c")).where("n > 2 and r is not null")

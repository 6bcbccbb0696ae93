"""Order-dependent queries (folds and stretches of rows), graph, ledger and run-log queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import back
from pitlake.functions.quantiles import exact_medians
from pitlake.operators.folds import betting, brake, fold, sticky_exposure
from pitlake.plans.registry import query
from pitlake.plans.views import bars_30m, bars_m, edges, px_d, using
from pitlake.plans.windows import by_day, by_sym
from pitlake.sources.tables import table


def _returns(spark: SparkSession, folder: str) -> DataFrame:
    return px_d(spark, folder).select(F.lit("index").alias("key"), "day", back("close", 1, by_day()).alias("r")).where("r is not null")


@query(
    using("px_d", recursive=True)
    + """, r as (select day, r, row_number() over (order by day) as i from (select day, close / lag(close) over (order by day) - 1 as r from px_d) where r is not null),
b as (select 0::bigint as i, cast(null as date) as day, 0.0::double as y, 1.0::double as m, 1.0::double as eq, 1.0::double as peak
  union all select r.i, r.day, z.y, z.m, b.eq * (1 + z.y), greatest(b.peak, b.eq * (1 + z.y)) from b join r on r.i = b.i + 1, lateral (select case when 1 - b.eq / b.peak >= 0.2 then 0.5 when 1 - b.eq / b.peak >= 0.1 then 2.0 / 3 else 1.0 end as m) k, lateral (select k.m as m, k.m * r.r - abs(k.m - b.m) * 10.0 / 1e4 as y) z)
select day, round(y, 8) as y, round(m, 6) as m, round(eq, 8) as equity from b where i > 0"""
)
def brake_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Exposure cut in drawdowns of the braked equity itself."""
    x = _returns(spark, folder)
    x = fold(x, ["key"], ["day"], brake(), "key string, day date, y double, m double, equity double")
    return x.select("day", F.round("y", 8).alias("y"), F.round("m", 6).alias("m"), F.round("equity", 8).alias("equity"))


@query(
    using("px_d", recursive=True)
    + """, v as (select day, r, lag(s) over (order by day) * sqrt(252) as vol from (select day, r, case when count(r) over w >= 20 then stddev_samp(r) over w end as s from (select day, close / lag(close) over (order by day) - 1 as r from px_d) window w as (order by day rows 19 preceding))),
r as (select *, row_number() over (order by day) as i from v where r is not null),
b as (select 0::bigint as i, cast(null as date) as day, 0.0::double as y, 1.0::double as e union all select r.i, r.day, z.e * r.r - abs(z.e - b.e) * 5.0 / 1e4, z.e from b join r on r.i = b.i + 1,
  lateral (select case when r.vol is null or r.vol <= 0 then b.e else least(1.5, 0.15 / r.vol) end as e) k, lateral (select case when abs(k.e - b.e) <= 0.1 then b.e else k.e end as e) z)
select day, round(y, 8) as y, round(e, 6) as exposure from b where i > 0"""
)
def vol_target_band(spark: SparkSession, folder: str) -> DataFrame:
    """Exposure by the deviation known the day before, kept within a band."""
    w = by_day().rowsBetween(-19, 0)
    x = px_d(spark, folder).select("day", back("close", 1, by_day()).alias("r")).select("day", "r", F.when(F.count("r").over(w) >= 20, F.stddev_samp("r").over(w)).alias("s"))
    x = x.select(F.lit("index").alias("key"), "day", "r", (F.lag("s").over(by_day()) * math.sqrt(252)).alias("vol")).where("r is not null")
    return fold(x, ["key"], ["day"], sticky_exposure(), "key string, day date, y double, exposure double").select("day", F.round("y", 8).alias("y"), F.round("exposure", 6).alias("exposure"))


@query(
    using("bars_m", recursive=True)
    + """, r as (select sym, day, x, row_number() over (partition by sym order by day) as i from (select sym, day, least(greatest(g, -1), 1) as x from (select sym, day, close / lag(close) over (partition by sym order by day) - 1 as g from bars_m) where g is not null)),
b as (select sym, 0::bigint as i, cast(null as date) as day, 0.0::double as n, 0.0::double as s, 0.0::double as q, 1.0::double as w, 1.0::double as best, 0.0::double as stake from (select distinct sym from r)
  union all select r.sym, r.i, r.day, b.n + 1, b.s + r.x, b.q + r.x * r.x, b.w * (1 + k.stake * r.x), greatest(b.best, b.w * (1 + k.stake * r.x)), k.stake from b join r on r.sym = b.sym and r.i = b.i + 1,
  lateral (select case when b.n >= 2 and b.q > 0 then least(greatest((b.s / b.n) / (b.q / b.n), 0), 0.5) else 0.0 end as stake) k)
select sym, day, round(stake, 6) as stake, round(best, 6) as best from b where i > 0 and day is not null"""
)
def betting_process(spark: SparkSession, folder: str) -> DataFrame:
    """Greatest wealth so far of a bettor on a positive mean, for each symbol by itself."""
    x = bars_m(spark, folder).select(F.col("sym").alias("key"), "day", back("close", 1, by_sym()).alias("x")).where("x is not null").withColumn("x", F.least(F.greatest("x", F.lit(-1.0)), F.lit(1.0)))
    x = fold(x, ["key"], ["day"], betting(), "key bigint, day date, stake double, wealth double, best double")
    return x.select(F.col("key").alias("sym"), "day", F.round("stake", 6).alias("stake"), F.round("best", 6).alias("best"))


#: Bars before a top, and bars after it and after a bottom, that must not pass it.
SPAN, CONFIRM = 12, 3


@query(
    using("bars_m")
    + f""", b as (select sym, day, high, low, close, row_number() over w as i, max(high) over past as past, count(*) over past as k, max(high) over ahead as after, min(low) over ahead as lows, count(*) over ahead as n from bars_m
  window w as (partition by sym order by day), past as (partition by sym order by day rows between {SPAN} preceding and 1 preceding), ahead as (partition by sym order by day rows between 1 following and {CONFIRM} following)),
g as (select *, count(*) filter (where k = {SPAN} and high >= past and n = {CONFIRM} and after < high) over (partition by sym order by i) as seg from b),
h as (select *, row_number() over w as pos, first_value(high) over w as lid, lead(seg, {CONFIRM}) over (partition by sym order by i) as seg3, max(high) over (partition by sym, seg order by i rows between unbounded preceding and {CONFIRM} following) as most from g window w as (partition by sym, seg order by i)),
c as (select *, seg > 0 and pos > 1 and seg3 = seg and lows >= low and most <= lid and low = min(case when pos > 1 then low end) over (partition by sym, seg order by i) as base from h),
f as (select *, base and i = min(case when base then i end) over (partition by sym, seg) as bottom from c),
d as (select *, coalesce(lag(bottom, {CONFIRM}) over w, false) as done, lag(lid, {CONFIRM}) over w as top0, lag(low, {CONFIRM}) over w as low0 from f window w as (partition by sym order by i)),
l as (select *, last_value(case when done then i end ignore nulls) over p as box, last_value(case when done then top0 end ignore nulls) over p as top, last_value(case when done then low0 end ignore nulls) over p as bot from d window p as (partition by sym order by i rows between unbounded preceding and 1 preceding)),
e as (select *, case when close > top then 'breakout' when close < bot then 'cancel' end as ends from l), o as (select *, i = min(case when ends is not null then i end) over (partition by sym, box) as first from e)
select sym, day, 'box' as event, top0 as top, low0 as bottom from d where done union all select sym, day, ends, top, bot from o where first and box is not null"""
)
def box_breakouts(spark: SparkSession, folder: str) -> DataFrame:
    """Completed, broken and cancelled boxes of each symbol's bars.

    A bar is a top if its high is the highest of SPAN bars before and above those of CONFIRM bars after it. The stretch from a top to the next one has a bottom:
    its first bar whose low none in the stretch before and none of the CONFIRM bars after goes below, as long as no high passes the top. With those bars the
    box is complete; the first later close above its top breaks out, below its bottom cancels it. A later box takes the place of one that is still open.
    No state is carried: stretches are numbered by a running count of tops, and a bar's box is the last that was complete before it.
    """
    w = by_sym()
    past, after = w.rowsBetween(-SPAN, -1), w.rowsBetween(1, CONFIRM)
    top = (F.count("*").over(past) == SPAN) & (F.col("high") >= F.max("high").over(past)) & (F.count("*").over(after) == CONFIRM) & (F.max("high").over(after) < F.col("high"))
    x = bars_m(spark, folder).select("sym", "day", "high", "low", "close", F.row_number().over(w).alias("i"), F.coalesce(top, F.lit(False)).cast("int").alias("top"), F.min("low").over(after).alias("lows"))
    x = x.withColumn("seg", F.sum("top").over(w))
    own = W.partitionBy("sym", "seg").orderBy("i")
    x = x.select("*", F.row_number().over(own).alias("pos"), F.first("high").over(own).alias("lid"), F.lead("seg", CONFIRM).over(w).alias("seg3"), F.max("high").over(own.rowsBetween(W.unboundedPreceding, CONFIRM)).alias("most"))
    base = (F.col("seg") > 0) & (F.col("pos") > 1) & (F.col("seg3") == F.col("seg")) & (F.col("lows") >= F.col("low")) & (F.col("most") <= F.col("lid")) & (F.col("low") == F.min(F.when(F.col("pos") > 1, F.col("low"))).over(own))
    x = x.withColumn("base", F.coalesce(base, F.lit(False)))
    x = x.withColumn("bottom", F.col("base") & (F.col("i") == F.min(F.when(F.col("base"), F.col("i"))).over(W.partitionBy("sym", "seg"))))
    done = F.lag(F.when(F.col("bottom"), F.struct(F.col("lid").alias("top"), F.col("low").alias("bottom"), (F.col("i") + CONFIRM).alias("box"))), CONFIRM).over(w)
    x = x.select("sym", "day", "close", "i", done.alias("done"))
    x = x.withColumn("now", F.last("done", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("ends", F.when(F.col("close") > F.col("now.top"), "breakout").when(F.col("close") < F.col("now.bottom"), "cancel"))
    first = F.col("i") == F.min(F.when(F.col("ends").isNotNull(), F.col("i"))).over(W.partitionBy("sym", "now.box"))
    x = x.withColumn("first", F.coalesce(first, F.lit(False)) & F.col("now").isNotNull())
    event = lambda name, box: F.struct(name.alias("event"), F.col(f"{box}.top").alias("top"), F.col(f"{box}.bottom").alias("bottom"))
    found = F.array_compact(F.array(F.when(F.col("done").isNotNull(), event(F.lit("box"), "done")), F.when(F.col("first"), event(F.col("ends"), "now"))))
    return x.select("sym", "day", F.explode(found).alias("e")).select("sym", "day", "e.*")


@query(
    using("bars_30m")
    + """, d as (select sym, day, first(open order by slot) as o, first(close order by slot) as c, first(low order by slot) as lo, first(high order by slot) as hi, min(slot) as s0 from bars_30m group by 1, 2),
k as (select b.sym, b.day, b.slot, b.open, b.low, b.high, b.close, sign(d.c - d.o) as side, d.lo, d.hi from bars_30m b join d using (sym, day) where b.slot > d.s0 and d.c <> d.o),
x as (select sym, day, any_value(side) as side, first(open order by slot) as entry, last(close order by slot) as fin, first(open order by slot) filter (where (side > 0 and low <= lo) or (side < 0 and high >= hi)) as stopped, any_value(lo) as lo, any_value(hi) as hi from k group by 1, 2)
select sym, day, cast(side as int) as side, round(side * (coalesce(case when side > 0 then least(stopped, lo) else greatest(stopped, hi) end, fin) / entry - 1), 6) + 0.0 as ret from x
where entry <> 0""".replace("coalesce(case when side > 0 then least(stopped, lo) else greatest(stopped, hi) end, fin)", "case when stopped is null then fin when side > 0 then least(stopped, lo) else greatest(stopped, hi) end")
)
def opening_range_stop(spark: SparkSession, folder: str) -> DataFrame:
    """By symbol and day: entry after the first bar in its direction, out at its other end if that is touched, else at the close. No loop: the first touch is an ordered aggregate."""
    b = bars_30m(spark, folder)
    w = W.partitionBy("sym", "day").orderBy("slot")
    first = lambda c: F.first(c).over(w)
    x = b.select("sym", "day", "slot", "open", "high", "low", "close", first("open").alias("o"), first("close").alias("c"), first("low").alias("lo"), first("high").alias("hi"), F.row_number().over(w).alias("k")).where("k > 1 and c <> o")
    side = F.signum(F.col("c") - F.col("o"))
    touched = ((side > 0) & (F.col("low") <= F.col("lo"))) | ((side < 0) & (F.col("high") >= F.col("hi")))
    x = x.groupBy("sym", "day", side.alias("side"), "lo", "hi").agg(F.min_by("open", "slot").alias("entry"), F.max_by("close", "slot").alias("fin"), F.min_by("open", F.when(touched, F.col("slot"))).alias("stopped")).where("entry <> 0")
    out = F.when(F.col("stopped").isNull(), F.col("fin")).when(F.col("side") > 0, F.least("stopped", "lo")).otherwise(F.greatest("stopped", "hi"))
    return x.select("sym", "day", F.col("side").cast("int").alias("side"), (F.round(F.col("side") * (out / F.col("entry") - 1), 6) + 0.0).alias("ret"))


@query(
    using("bars_30m")
    + " select sym, slot, round(sum(turnover) over w / sum(n) over w, 9) as vwap, round(avg(n) over p, 6) as usual from bars_30m window w as (partition by sym, day order by slot), p as (partition by sym, hm order by day rows between 14 preceding and 1 preceding)"
)
def session_average(spark: SparkSession, folder: str) -> DataFrame:
    """The session's running mean and the usual count of the same half-hour on the 14 days before."""
    w = W.partitionBy("sym", "day").orderBy("slot")
    p = W.partitionBy("sym", "hm").orderBy("day").rowsBetween(-14, -1)
    return bars_30m(spark, folder).select("sym", F.col("slot").cast("timestamp_ntz").alias("slot"), F.round(F.sum("turnover").over(w) / F.sum("n").over(w), 9).alias("vwap"), F.round(F.avg("n").over(p), 6).alias("usual"))


@query(using("bars_30m") + ", d as (select sym, day, sum(n) as n from bars_30m group by 1, 2), m as (select sym, median(n) as m from d group by 1) select d.sym, d.day, cast(d.n as bigint) as n from d join m using (sym) where d.n >= 0.5 * m.m")
def half_day_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Days with at least half a symbol's median count."""
    d = bars_30m(spark, folder).groupBy("sym", "day").agg(F.sum("n").alias("n"))
    m = exact_medians(d, "sym", "n", "m").select(F.col("sym").alias("_s"), "m")
    return d.join(m, F.col("sym") == F.col("_s")).where("n >= 0.5 * m").select("sym", "day", "n")


@query(
    using("edges", recursive=True)
    + """, u as (select src as a, dst as b from edges union select dst, src from edges), h as (select 'r1' as node, 0 as hops union select u.b, h.hops + 1 from h join u on u.a = h.node where h.hops < 2) select node, min(hops) as hops from h group by node"""
)
def graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes within two steps of one region, either way along edges: one join for each step, visited nodes left out."""
    e = edges(spark, folder)
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    seen = spark.createDataFrame([("r1", 0)], "node string, hops int")
    front = seen
    for step in (1, 2):
        front = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(step))
        seen = seen.unionByName(front)
    return seen


@query(using("edges") + " select rel, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from edges group by rel")
def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by kind, with their distinct ends."""
    return edges(spark, folder).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(
    """with d as (select distinct seq, prev, hash from ledger), c as (select *, lag(hash) over (order by seq) as before, seq - lag(seq) over (order by seq) as step from d) select seq, prev is not distinct from before as linked from c where step = 1"""
)
def ledger_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each entry names its predecessor's hash: an equality join on seq - 1, so no task walks the whole chain. Only entries whose predecessor is there."""
    d = table(spark, folder, "ledger").select("seq", "prev", "hash").distinct()
    before = d.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    return d.join(before, "seq").select("seq", F.col("prev").eqNullSafe(F.col("before")).alias("linked"))


@query(
    """with m as (select distinct message_id, run_id, topic, created_at from agent_messages) select message_id, row_number() over (partition by run_id order by created_at, message_id) as seq, count(*) over (partition by run_id, topic order by created_at, message_id rows unbounded preceding) as of_topic from m"""
)
def message_seq(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each message in its run and topic by time."""
    m = table(spark, folder, "agent_messages").select("message_id", "run_id", "topic", "created_at").distinct()
    return m.select("message_id", F.row_number().over(W.partitionBy("run_id").orderBy("created_at", "message_id")).cast("bigint").alias("seq"), F.count("*").over(W.partitionBy("run_id", "topic").orderBy("created_at", "message_id").rowsBetween(W.unboundedPreceding, 0)).alias("of_topic"))


@query(
    """with l as (select distinct seq, type, written_at, source, ticker from ledger), k as (select *, row_number() over (partition by source, type order by written_at desc, seq desc) as r from l) select source, type, seq, epoch_us(written_at) as written_us, ticker from k where r = 1"""
)
def latest_heartbeat(spark: SparkSession, folder: str) -> DataFrame:
    """The newest entry of each source and kind: an aggregate in place of a window."""
    x = table(spark, folder, "ledger").groupBy("source", "type").agg(F.max(F.struct("written_at", "seq", "ticker")).alias("m"))
    return x.select("source", "type", "m.seq", F.unix_micros("m.written_at").alias("written_us"), "m.ticker")


@query(
    """with d as (select distinct seq, type, accession, ticker, cohort, logodds, written_at from ledger), o as (select accession, last(logodds order by written_at, seq) as outcome from d where type = 'outcome' group by 1), s as (select accession, last(logodds order by written_at, seq) as signal from d where type = 'signal' group by 1)
select d.seq, d.accession, round(o.outcome, 6) as outcome, round(s.signal, 6) as signal from d left join o using (accession) left join s using (accession) where d.type = 'decision'"""
)
def decision_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions with the last outcome and signal of their filing: the right sides are made unique before they are joined."""
    d = table(spark, folder, "ledger").select("seq", "type", "accession", "logodds", "written_at")
    at = lambda k: F.max_by(F.when(F.col("type") == k, F.col("logodds")), F.when(F.col("type") == k, F.struct("written_at", "seq")))
    last = d.where("type in ('outcome', 'signal')").groupBy(F.col("accession").alias("_a")).agg(at("outcome").alias("outcome"), at("signal").alias("signal"))
    x = d.where("type = 'decision'").select("seq", "accession").distinct().join(last, F.col("accession") == F.col("_a"), "left")
    return x.select("seq", "accession", F.round("outcome", 6).alias("outcome"), F.round("signal", 6).alias("signal"))


_SESSIONS = """, d0 as (select sym, day, max(high) as h, min(low) as lo, last(close order by slot) as c from bars_30m group by 1, 2), d as (select sym, day, lag(h) over w as high0, lag(lo) over w as low0, lag(c) over w as close0 from d0 window w as (partition by sym order by day)),
s as (select b.*, high0, low0, close0, first_value(open) over v as start, lead(open) over v as following, lead(b.slot) over v is null as last, b.sym || '|' || b.day as key from bars_30m b join d using (sym, day) window v as (partition by b.sym, b.day order by b.slot))"""


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Half-hour bars with their session's start, the next open, and the session before's range and last close."""
    b = bars_30m(spark, folder)
    days = b.groupBy("sym", "day").agg(F.max("high").alias("h"), F.min("low").alias("lo"), F.max_by("close", "slot").alias("c"))
    w = W.partitionBy("sym").orderBy("day")
    days = days.select("sym", "day", F.lag("h").over(w).alias("high0"), F.lag("lo").over(w).alias("low0"), F.lag("c").over(w).alias("close0"))
    s = W.partitionBy("sym", "day").orderBy("slot")
    x = b.join(days, ["sym", "day"]).select("*", F.first("open").over(s).alias("start"), F.lead("open").over(s).alias("following"), F.lead("slot").over(s).isNull().alias("last"))
    return x.withColumn("key", F.concat_ws("|", "sym", F.col("day").cast("string")))


#: Cost of one side of a trade within a session.
SIDE = 0.0005


@query(
    using("bars_30m") + _SESSIONS
    + f""", m as (select *, abs(close / nullif(start, 0) - 1) as move from s), u as (select *, case when count(move) over p >= 7 then avg(move) over p end as usual, sum(turnover) over v / sum(n) over v as mean from m
  window p as (partition by sym, hm order by day rows between 14 preceding and 1 preceding), v as (partition by sym, day order by slot)),
w as (select *, greatest(start, close0) * (1 + usual) as upper, least(start, close0) * (1 - usual) as lower from u),
g as (select *, case when last then 0 when usual is null or close0 is null or mean is null then null when close > greatest(upper, mean) then 1 when close < least(lower, mean) then -1 else 0 end as wanted from w),
q as (select *, coalesce(last_value(wanted ignore nulls) over (partition by sym, day order by slot), 0) as position from g), r as (select *, coalesce(lag(position) over (partition by sym, day order by slot), 0) as before from q)
select key, slot, cast(position as int) as position, round(before * coalesce(coalesce(following, close) / nullif(open, 0) - 1, 0) - {SIDE} * abs(position - before), 9) + 0.0 as gain from r"""
)
def noise_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Positions by bands as wide as the usual move at that time of day on the 14 days before, around the session's start and the last close.

    At each bar: long above both the upper band and the session's mean, short below both the lower band and the mean, flat between and at the last bar, as
    before where a band isn't known. Traded at the next open, at the last close in the end. What is held follows from the bar alone, so there is no state.
    """
    p = W.partitionBy("sym", "hm").orderBy("day").rowsBetween(-14, -1)
    s = W.partitionBy("sym", "day").orderBy("slot")
    x = _sessions(spark, folder).withColumn("move", F.abs(F.try_divide("close", "start") - 1))
    x = x.select("*", F.when(F.count("move").over(p) >= 7, F.avg("move").over(p)).alias("usual"), (F.sum("turnover").over(s) / F.sum("n").over(s)).alias("mean"))
    upper, lower = F.greatest("start", "close0") * (1 + F.col("usual")), F.least("start", "close0") * (1 - F.col("usual"))
    unknown = F.col("usual").isNull() | F.col("close0").isNull() | F.col("mean").isNull()
    wanted = F.when(F.col("last"), 0).when(unknown, F.lit(None)).when(F.col("close") > F.greatest(upper, "mean"), 1).when(F.col("close") < F.least(lower, "mean"), -1).otherwise(0)
    x = x.withColumn("wanted", wanted).withColumn("position", F.coalesce(F.last("wanted", ignorenulls=True).over(s), F.lit(0))).withColumn("before", F.coalesce(F.lag("position").over(s), F.lit(0)))
    gain = F.col("before") * F.coalesce(F.try_divide(F.coalesce("following", "close"), "open") - 1, F.lit(0.0)) - SIDE * F.abs(F.col("position") - F.col("before"))
    return x.select("key", F.col("slot").cast("timestamp_ntz").alias("slot"), "position", (F.round(gain, 9) + 0.0).alias("gain"))


@query(
    using("bars_30m") + _SESSIONS
    + f""", x as (select *, (high0 - low0) / 4 as quarter, (high0 + low0) / 2 as middle from s where high0 > low0), y as (select *, case when close <= low0 + quarter then 1 when close >= high0 - quarter then -1 end as wants from x),
e as (select key, min(slot) as entered, arg_min(wants, slot) as side, arg_min(following, slot) as entry from y where wants is not null and not last group by key),
l as (select y.key, min(slot) as out, arg_min(case when last then close else following end, slot) as price from y join e using (key) where slot > entered and (last or (side > 0 and (close >= middle or close < low0 - quarter)) or (side < 0 and (close <= middle or close > high0 + quarter))) group by y.key)
select key, cast(side as int) as side, entered, out, round(side * (price / nullif(entry, 0) - 1) - 2 * {SIDE}, 9) as gain from e join l using (key)"""
)
def box_reversions(spark: SparkSession, folder: str) -> DataFrame:
    """At most one trade a session within the range of the session before: entered at the next open after the first close in an outer quarter, left at the next
    open once a close reaches the middle or leaves the range by a quarter of its width, else at the last close. Two ordered aggregates, no state."""
    x = _sessions(spark, folder).where("high0 > low0").withColumn("quarter", (F.col("high0") - F.col("low0")) / 4).withColumn("middle", (F.col("high0") + F.col("low0")) / 2)
    wants = F.when(F.col("close") <= F.col("low0") + F.col("quarter"), 1).when(F.col("close") >= F.col("high0") - F.col("quarter"), -1)
    own = W.partitionBy("key")
    first = F.min(F.when(~F.col("last"), F.when(F.col("wants").isNotNull(), F.struct("slot", "wants", "following")))).over(own)
    x = x.withColumn("wants", wants).withColumn("e", first).where(F.col("slot") > F.col("e.slot"))
    side = F.col("e.wants")
    left = F.col("last") | ((side > 0) & ((F.col("close") >= F.col("middle")) | (F.col("close") < F.col("low0") - F.col("quarter")))) | ((side < 0) & ((F.col("close") <= F.col("middle")) | (F.col("close") > F.col("high0") + F.col("quarter"))))
    x = x.where(left).groupBy("key", "e").agg(F.min(F.struct("slot", F.when(F.col("last"), F.col("close")).otherwise(F.col("following")).alias("price"))).alias("o"))
    gain = side * (F.try_divide("o.price", "e.following") - 1) - 2 * SIDE
    return x.select("key", side.alias("side"), F.col("e.slot").cast("timestamp_ntz").alias("entered"), F.col("o.slot").cast("timestamp_ntz").alias("out"), F.round(gain, 9).alias("gain"))

"""Tables written in the formats of vendors and read back by the readers: what comes back must be what went out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.functions.columns import normal_cdf, normal_ppf, numbers
from pitlake.operators.asof import as_of, guarded
from pitlake.plans.registry import query
from pitlake.plans.scores import _cdf_sql
from pitlake.plans.valuation import logistic, ridge
from pitlake.plans.views import bars_m, preds, using
from pitlake.session import scratch
from pitlake.sources import readers
from pitlake.sources.tables import table


@query(using("bars_m") + " select cast(sym as varchar) as sym, day, round(open, 9) as open, round(high, 9) as high, round(low, 9) as low, round(close, 9) as close, volume from bars_m")
def csv_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly bars as CSV files with a header, among them lines without a date, which are left out."""
    x = bars_m(spark, folder).select(F.col("day").cast("string").alias("Date"), F.col("sym").cast("string").alias("Ticker"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    x = x.unionByName(x.where("pmod(crc32(Ticker), 7) = 0").withColumn("Date", F.lit("not a day")))
    path = scratch(spark, "csv")
    x.write.option("header", True).csv(path)
    y = readers.ohlcv_csv(spark, path)
    return y.select("sym", "day", *[F.round(c, 9).alias(c) for c in ("open", "high", "low", "close")], "volume")


_REGIONS = """with t as (select n_regionkey as r, cast(l_shipdate as date) as day, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(l_quantity) as double) as close from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2)"""


@query(_REGIONS + " select 'R' || r as sym, day, round(close, 9) as close from t where day in (select day from t group by day having count(*) = (select count(distinct r) from t))")
def wide_closes(spark: SparkSession, folder: str) -> DataFrame:
    """The regions' daily prices as CSV files with a column for each: days on which a region has none are left out whole."""
    s = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")  # 25 nations
    x = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("Date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.groupBy("Date", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("r")).agg((F.sum("v").cast("double") / F.sum("l_quantity").cast("double")).alias("c"))
    names = sorted("R" + str(r[0]) for r in table(spark, folder, "region").select("r_regionkey").collect())  # five regions
    path = scratch(spark, "wide")
    x.groupBy("Date").pivot("r", names).agg(F.first("c")).write.option("header", True).csv(path)
    return readers.wide_closes_csv(spark, path, names).select("sym", "day", F.round("close", 9).alias("close"))


@query(
    using("preds")
    + """, x as (select *, ascii(right(run_id, 1)) % 7 = 0 as torn from preds) select arm, cast(count(*) as bigint) as n, round(sum(p), 4) as p, count(*) filter (where up) as ups, min(resolve_date) as first from x where not torn group by arm union all select 'damaged', count(*), null, null, null from x where torn"""
)
def torn_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions as JSON lines of which some are torn: what is readable by arm, and how many lines were damaged. None is lost."""
    x = preds(spark, folder).select("arm", "cutoff", F.col("sym").alias("ticker"), "resolve_date", "p", "ret", "up", "run_id")
    line = F.to_json(F.struct("arm", "cutoff", "ticker", "resolve_date", "p", "ret", "up"))
    torn = F.ascii(F.right("run_id", F.lit(1))) % 7 == 0
    path = scratch(spark, "lines")
    x.select(F.when(torn, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.json_lines(spark, path, readers.PREDICTIONS)
    a = good.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("p"), F.count(F.when(F.col("up"), 1)).alias("ups"), F.min("resolve_date").alias("first"))
    b = bad.agg(F.count("*").alias("n")).select(F.lit("damaged").alias("arm"), "n", F.lit(None).cast("double").alias("p"), F.lit(None).cast("bigint").alias("ups"), F.lit(None).cast("date").alias("first"))
    return a.unionByName(b)


@query(
    """with b as (select distinct bar_id, timestamp as t, open, high, low, close, volume from bars), v as (select 'kline' as vendor, cast(timezone('UTC', t) as date) as day, * from b union all select 'zulu', cast(timezone('America/New_York', t) as date), * from b union all select 'epoch', cast(timezone('America/New_York', t) as date), * from b)
select vendor, day, count(*) as n, round(cast(sum(cast(close as decimal(24,6))) as double), 4) as close, round(max(high), 6) as high, cast(sum(case when vendor = 'epoch' then coalesce(volume, 0) else volume end) as double) as volume from v group by 1, 2"""
)
def vendor_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars as three vendors send them - arrays of texts by milliseconds, texts in UTC, numbers of milliseconds -, by the day that each counts them to."""
    b = table(spark, folder, "bars").select("bar_id", F.unix_millis("timestamp").alias("ms"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v")).distinct()
    kline = readers.kline_bars(b.select(F.array(*[F.col(x).cast("string") for x in ("ms", *"ohlcv")]).alias("k")))
    iso = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    zulu = readers.zulu_bars(b.select(iso.alias("t"), *"ohlcv"))
    epoch = readers.epoch_bars(b.select(F.col("ms").alias("t"), *"ohlcv"))
    x = kline.withColumn("vendor", F.lit("kline")).unionByName(zulu.withColumn("vendor", F.lit("zulu"))).unionByName(epoch.withColumn("vendor", F.lit("epoch")))
    return x.groupBy("vendor", "day").agg(F.count("*").alias("n"), F.round(F.sum(F.col("close").cast("decimal(24,6)")).cast("double"), 4).alias("close"), F.round(F.max("high"), 6).alias("high"), F.sum("volume").alias("volume"))


@query("select cik, period_end, source, arg_min(value, struct_pack(f := first_filed, i := fact_id)) as value, min(first_filed) as first_filed from (select distinct fact_id, cik, period_end, source, value, first_filed from quarters where value is not null and first_filed is not null) group by 1, 2, 3")
def first_reported_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Of each issuer, period and source the value that became public first."""
    q = table(spark, folder, "quarters").where("value is not null and first_filed is not null")
    return readers.first_reported(q, ["cik", "period_end", "source"], "first_filed", "fact_id", "value")


@query("select coalesce(ticker, 'none') || ' & ' || coalesce(doc_kind, '') as title, 'https://example.org/' || doc_id || '/' || k as link, cast(published_on as varchar) as published from documents, range(1, 3) r(k)")
def feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, links and dates of pages of a feed's format, one page of two items for each document."""
    d = table(spark, folder, "documents")
    title = F.concat(F.coalesce("ticker", F.lit("none")), F.lit(" & "), F.coalesce("doc_kind", F.lit("")))
    item = lambda k: F.concat(F.lit("<item><title><![CDATA["), title, F.lit("]]></title>\n<link>https://example.org/"), F.col("doc_id").cast("string"), F.lit(f"/{k}</link>"), F.coalesce(F.concat(F.lit("<pubDate>"), F.col("published_on").cast("string"), F.lit("</pubDate>")), F.lit("")), F.lit("</item>"))
    pages = d.select(F.concat(F.lit("<rss><channel>"), item(1), item(2), F.lit("</channel></rss>")).alias("page"))
    return readers.feed_items(pages, "page").withColumn("published", F.nullif("published", F.lit("")))


@query(
    """with f as (select d.doc_id, i.cik, d.published_on as filed, case doc_kind when 'earnings_release' then '2.02, 9.01' when 'filing' then '5.02,9.01' else '8.01' end as items from documents d join issuers i using (ticker) where d.published_on is not null),
m as (select distinct cik, year(first_filed) as y from quarters) select f.doc_id, f.cik, f.items from f semi join m on m.cik = f.cik and m.y = year(f.filed) where f.items like '%9.01%'"""
)
def item_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Filings that list an item, of issuers that reported in the year of filing."""
    kind = F.when(F.col("doc_kind") == "earnings_release", "2.02, 9.01").when(F.col("doc_kind") == "filing", "5.02,9.01").otherwise("8.01")
    f = table(spark, folder, "documents").where("published_on is not null").select("doc_id", "ticker", F.col("published_on").alias("filed"), kind.alias("items")).join(table(spark, folder, "issuers").select("ticker", "cik"), "ticker")
    m = table(spark, folder, "quarters").select("cik", F.year("first_filed").alias("year")).distinct()
    return readers.item_events(f, "items", "9.01", m).select("doc_id", "cik", "items")


@query("with e as (select event_id, (value - 50) / 20 as z, 0.001 + (event_id % 999) / 1000.0::double as p from events) select event_id, round(" + _cdf_sql("z") + ", 6) as below, round(p, 6) as back from e")
def normal_values(spark: SparkSession, folder: str) -> DataFrame:
    """The normal distribution at a value, and at the place where it reaches a probability, which gives that back."""
    e = table(spark, folder, "events").select("event_id", ((F.col("value") - 50) / 20).alias("z"), (0.001 + F.pmod("event_id", F.lit(999)) / 1000.0).alias("p")).withColumn("q", normal_ppf(F.col("p")))
    return e.select("event_id", F.round(normal_cdf(F.col("z")), 6).alias("below"), F.round(normal_cdf(F.col("q")), 6).alias("back"))


@query(
    r"""with n as (select doc_id, [try_cast(regexp_replace(m, '[()$,-]', '', 'g') as double) * case when m like '(%)' or contains(m, '-') then -1 else 1 end for m in regexp_extract_all(text, '\(?-?\$?[0-9][0-9,]*(?:\.[0-9]+)?\)?')] as xs from documents where text is not null)
select doc_id, cast(len(xs) as bigint) as n, list_min(xs) + 0.0 as low, list_max(xs) + 0.0 as high, cast(len(list_distinct(list_filter(xs, lambda x: abs(x) >= 1000))) as bigint) as large from n"""
)
def numbers_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The signed numbers that each whole text writes: how many, the least, the greatest, and how many different ones of a thousand and more."""
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", numbers(F.col("text")).alias("x"))
    large = F.array_distinct(F.filter("x", lambda v: F.abs(v) >= 1000))
    return x.select("doc_id", F.size("x").cast("bigint").alias("n"), (F.array_min("x") + 0.0).alias("low"), (F.array_max("x") + 0.0).alias("high"), F.size(large).cast("bigint").alias("large"))


@query("select ticker, count(*) as n, epoch_us(max(timestamp)) as last_us from bars where ticker is not null group by ticker")
def guarded_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars read under a cutoff at their own last time: the guard is part of the plan, raises at any later row, and here lets all pass."""
    b = table(spark, folder, "bars").select("ticker", "timestamp").where("ticker is not null")
    last = b.agg(F.max("timestamp")).first()[0]  # one time
    with as_of(last):
        x = guarded(b, "timestamp", "bars") if last is not None else b
    return x.groupBy("ticker").agg(F.count("*").alias("n"), F.unix_micros(F.max("timestamp")).alias("last_us"))


@query(
    using("preds")
    + """, x as (select p, cast(h as double) as h, ret as y from preds), s as (select count(*) as n, stddev_pop(p) as s1, stddev_pop(h) as s2, corr(p, h) as r, covar_pop(p, y) as c1, covar_pop(h, y) as c2, avg(y) as m from x), k as (select *, 1 + 10.0 / n as d, c1 / s1 as b1, c2 / s2 as b2 from s)
select 'p' as name, round((d * b1 - r * b2) / (d * d - r * r), 8) as weight from k union all select 'h', round((d * b2 - r * b1) / (d * d - r * r), 8) from k union all select 'mean', round(m, 8) from k"""
)
def ridge_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of standardised features under a penalty, by sums that one pass makes."""
    w, m = ridge(preds(spark, folder), ["p", "h"], "ret", 10.0)
    return spark.createDataFrame([("p", round(w[0], 8)), ("h", round(w[1], 8)), ("mean", round(m, 8))], "name string, weight double")


def _newton(passes: int) -> str:
    steps = ["w0 as (select 0.0::double as a, 0.0::double as b)"]
    for k in range(1, passes + 1):
        steps.append(
            f"s{k} as materialized (select any_value(a) as a, any_value(b) as b, sum((q - y) * p) + any_value(a) as g1, sum(q - y) as g0, sum(q * (1 - q) * p * p) + 1 as h11, sum(q * (1 - q) * p) as h10, sum(q * (1 - q)) as h00 from (select p, y, a, b, 1 / (1 + exp(-(a * p + b))) as q from x, w{k - 1}))"
        )
        steps.append(f"w{k} as materialized (select a - (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) as a, b - (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) as b from s{k})")
    return ", ".join(steps)


@query(using("preds") + ", x as (select p, case when up then 1.0::double else 0.0 end as y from preds), " + _newton(9) + " select 'p' as name, round(a, 6) as weight from w9 union all select 'free', round(b, 6) from w9")
def logistic_weights(spark: SparkSession, folder: str) -> DataFrame:
    """A logistic model of the direction by the forecast, under a penalty, by Newton's method: only sums leave a pass."""
    w = logistic(preds(spark, folder).withColumn("y", F.col("up").cast("double")), ["p"], "y", 1.0)
    return spark.createDataFrame([("p", round(w[0], 6)), ("free", round(w[1], 6))], "name string, weight double")


@query(
    """with d as (select distinct cast(timestamp as date) as day from bars where timestamp is not null), s as (select distinct ticker from bars where ticker is not null), b as (select ticker, cast(timestamp as date) as day, count(*) as n, max(close) as high from bars group by 1, 2),
g as (select s.ticker as sym, d.day, b.n, b.high from s cross join d left join b on b.ticker = s.ticker and b.day = d.day) select sym, count(*) as days, count(n) as known, round(max(high), 6) as high from g group by sym"""
)
def panel_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every ticker on every day of the calendar: how many days that are, and on how many it has bars. The calendar is what each ticker explodes."""
    b = table(spark, folder, "bars").select(F.col("ticker").alias("sym"), F.col("timestamp").cast("date").alias("day"), "close").where("sym is not null and day is not null")
    daily = b.groupBy("sym", "day").agg(F.count("*").alias("n"), F.max("close").alias("high"))
    g = readers.panel(daily, daily.select("day"), daily.select("sym"))
    return g.groupBy("sym").agg(F.count("*").alias("days"), F.count("n").alias("known"), F.round(F.max("high"), 6).alias("high"))


@query(
    """with s as (select distinct ticker as sym, list_sum(list_transform(string_split(ticker, ''), lambda x: ascii(x))) as seed from issuers), d as (select cast(d as date) as day, cast(d as date) - date '1970-01-01' as n from generate_series(timestamp '2020-01-01', timestamp '2021-12-31', interval 1 day) t(d))
select sym, day, round(50 + seed % 100 + 5 * sin((n + seed) / 30.0::double) + (n - 10000) * 0.002::double * (1 + seed % 3), 4) as close from s, d"""
)
def synthetic_market(spark: SparkSession, folder: str) -> DataFrame:
    """Prices that follow from ticker and day alone."""
    names = [r[0] for r in table(spark, folder, "issuers").select("ticker").distinct().collect()]  # the dimension of issuers
    return readers.synthetic_prices(spark, names, "2020-01-01", "2021-12-31")


@query(
    """with l as (select distinct seq, accession, type, written_at, ticker from ledger where accession is not null), k as (select *, row_number() over (partition by accession, type order by written_at desc nulls last, seq desc) as r from l) select accession, type, seq, ticker from k where r = 1"""
)
def latest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What upserts by accession and kind leave of an append-only ledger: the newest row of each, found by an aggregate."""
    x = table(spark, folder, "ledger").where("accession is not null").select("seq", "accession", "type", "written_at", "ticker").distinct()
    return readers.latest_by_key(x, ["accession", "type"], ["written_at", "seq"]).select("accession", "type", "seq", "ticker")


@query(
    """with q as (select distinct fact_id, cik, source, period_end, first_filed from quarters where first_filed is not null), v as (select cik, source, period_end, first_filed, min(fact_id) as fact_id from q group by 1, 2, 3, 4)
select fact_id, first_filed as valid_from, lead(first_filed) over (partition by cik, source, period_end order by first_filed) as valid_to from v"""
)
def fact_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The days from which and until which each fact is its period's current version."""
    q = table(spark, folder, "quarters").where("first_filed is not null").groupBy("cik", "source", "period_end", "first_filed").agg(F.min("fact_id").alias("fact_id"))
    return readers.versions(q, ["cik", "source", "period_end"], "first_filed").select("fact_id", "valid_from", "valid_to")


@query("select ticker, count(*) as n, count(*) filter (where retrieved_at < timestamptz '2020-01-01 00:00:00+00') as before from (select distinct evidence_id, ticker, retrieved_at from evidence_refs) where ticker is not null and retrieved_at <= timestamptz '2020-01-01 00:00:00+00' group by ticker")
def known_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence known at a cutoff, and what was known strictly before it: filters that reach the scan."""
    from pitlake.operators.asof import known

    x = table(spark, folder, "evidence_refs").select("evidence_id", "ticker", "retrieved_at").where("ticker is not null")
    at = spark.range(1).select(F.to_timestamp(F.lit("2020-01-01 00:00:00+00:00")).alias("t")).first().t  # one time
    with as_of(at):
        upto, before = known(x, "retrieved_at").distinct(), known(x, "retrieved_at", strict=True).distinct()
    a = upto.groupBy("ticker").agg(F.count("*").alias("n"))
    b = before.groupBy(F.col("ticker").alias("_t")).agg(F.count("*").alias("before"))
    return a.join(b, F.col("ticker") == F.col("_t"), "left").select("ticker", "n", F.coalesce("before", F.lit(0)).cast("bigint").alias("before"))


@query("select event_type, count(distinct user_id) as users, true as near from events group by event_type")
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users by type, exactly, and whether a sketch of bounded size comes within a tenth of them."""
    e = table(spark, folder, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return e.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("near"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice / 8, 2) as up, round_even(l_extendedprice / 8, 2) as even, floor(l_extendedprice / 8) as down from (select l_orderkey, l_linenumber, cast(floor(l_extendedprice) as double) as l_extendedprice from lineitem)")
def rounded_values(spark: SparkSession, folder: str) -> DataFrame:
    """Halves away from zero, halves to the even digit, and down."""
    x = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice").cast("double") / 8).alias("v"))
    return x.select("l_orderkey", "l_linenumber", F.round("v", 2).alias("up"), F.bround("v", 2).alias("even"), F.floor("v").cast("double").alias("down"))

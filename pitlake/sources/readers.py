"""Readers of bars, predictions, reports, filings and texts in the formats they come in. All declare their schema; none infers it from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OHLCV = "Date string, Ticker string, Open double, High double, Low double, Close double, Volume double"
PREDICTIONS = "arm string, cutoff date, ticker string, resolve_date date, p double, ret double, up boolean"


def ohlcv_csv(spark: SparkSession, path: str) -> DataFrame:
    """sym, day, open, high, low, close, volume of a CSV with a header; lines with an unreadable date are left out."""
    x = spark.read.schema(OHLCV).option("header", True).option("mode", "PERMISSIVE").csv(path)
    day = F.expr("try_to_timestamp(Date, 'yyyy-MM-dd')").cast("date")
    return x.select(F.col("Ticker").alias("sym"), day.alias("day"), *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")]).where("day is not null")


def wide_closes_csv(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    """sym, day, close of a CSV with one column for each symbol; a day with any missing close is left out whole, as are lines without a date."""
    schema = "Date string, " + ", ".join(f"`{s}` double" for s in symbols)
    x = spark.read.schema(schema).option("header", True).csv(path).withColumn("day", F.expr("try_to_timestamp(Date, 'yyyy-MM-dd')").cast("date")).where("day is not null").dropna(subset=symbols)
    return x.unpivot(["day"], symbols, "sym", "close").select("sym", "day", "close")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(readable rows, damaged lines) of JSON lines: torn lines are kept apart and can be counted, never lost."""
    row = F.from_json("value", f"{schema}, _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    x = spark.read.text(path).where(F.trim("value") != "").select(row.alias("r")).select("r.*")
    return x.where("_damaged is null").drop("_damaged"), x.where("_damaged is not null").select(F.col("_damaged").alias("line"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, PREDICTIONS)[0]


def run_reports(spark: SparkSession, glob: str, schema: str, required: list[str]) -> DataFrame:
    """One row for each JSON report that has every required field; unfinished and unreadable ones are left out. file: where it came from."""
    x = spark.read.schema(f"{schema}, _damaged string").option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(glob)
    x = x.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    for field in required:
        x = x.where(F.col(field).isNotNull())
    return x.where("_damaged is null").drop("_damaged")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file under a path of any file system that Spark reads. A file is hashed in one task, as SHA-256 can't be put together from parts."""
    x = spark.read.format("binaryFile").load(path)
    return x.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def gated(spark: SparkSession, path: str, schema: str, provenance: str) -> DataFrame:
    """JSON lines of one file, refused unless the provenance document, on any file system, names its SHA-256. The file is hashed by a task, not by the driver."""
    said = spark.read.text(provenance, wholetext=True).select(F.get_json_object("value", "$.sha256").alias("want"))
    found = [r[0] for r in digests(spark, path).select("sha256").limit(2).collect()]  # one number of one file
    if len(found) != 1 or (said.first() or [None])[0] != found[0]:
        raise ValueError(f"{path} isn't the file that {provenance} describes")
    return json_lines(spark, path, schema)[0]


def _bars(x: DataFrame, day: Column, prices: dict[str, Column]) -> DataFrame:
    return x.select(day.alias("day"), *[c.cast("double").alias(k) for k, c in prices.items()])


def kline_bars(x: DataFrame) -> DataFrame:
    """Bars of rows (k: array of strings: epoch milliseconds, open, high, low, close, volume), by UTC day."""
    return _bars(x, F.timestamp_millis(F.expr("cast(k[0] as bigint)")).cast("date"), {n: F.expr(f"k[{i}]") for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)})


def zulu_bars(x: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Bars of rows (t: ISO text in UTC, o, h, l, c, v), by day in the exchange's zone."""
    day = F.from_utc_timestamp(F.to_timestamp(F.regexp_replace("t", "[TZ]", " "), "yyyy-MM-dd HH:mm:ss "), zone).cast("date")
    return _bars(x, day, dict(zip(("open", "high", "low", "close", "volume"), map(F.col, "ohlcv"), strict=True)))


def epoch_bars(x: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Bars of rows (t: epoch milliseconds, o, h, l, c, v), by day in the exchange's zone; a missing volume is 0."""
    day = F.from_utc_timestamp(F.timestamp_millis(F.col("t")), zone).cast("date")
    return _bars(x, day, dict(zip(("open", "high", "low", "close"), map(F.col, "ohlc"), strict=True)) | {"volume": F.coalesce(F.col("v"), F.lit(0))})


def first_reported(facts: DataFrame, keys: list[str], filed: str, accession: str, value: str) -> DataFrame:
    """The value of each key that was filed first, the smallest accession among those of one day: an aggregate, which combines before the shuffle."""
    return facts.groupBy(*keys).agg(F.min_by(value, F.struct(filed, accession)).alias(value), F.min(filed).alias(filed))


def item_events(filings: DataFrame, items: str, wanted: str, members: DataFrame, cik: str = "cik", day: str = "filed") -> DataFrame:
    """Filings that list an item, of companies that were members in the year of filing."""
    x = filings.where(F.array_contains(F.transform(F.split(items, ","), lambda x: F.trim(x)), wanted)).withColumn("_y", F.year(day))
    m = members.select(F.col("cik").alias("_c"), F.col("year").alias("_m")).distinct()
    return x.join(m, (x[cik] == m["_c"]) & (x["_y"] == m["_m"]), "left_semi").drop("_y")


def whole_texts(spark: SparkSession, glob: str) -> DataFrame:
    """key, text of one file each, gzip or plain."""
    x = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return x.select(F.regexp_replace("file", r"\.txt(\.gz)?$", "").alias("key"), "text")


def feed_items(pages: DataFrame, text: str) -> DataFrame:
    """title, link, published of every item of RSS pages, by patterns over the page's text."""
    x = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))).alias("i"))
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    return x.select(inner("title").alias("title"), inner("link").alias("link"), inner("pubDate").alias("published"))


def latest_by_key(history: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key of an append-only table: what an upsert leaves."""
    x = history.groupBy(*keys).agg(F.max_by(F.struct(*history.columns), F.struct(*version)).alias("_r"))
    return x.select("_r.*")


def complete_days(panel: DataFrame, sym: str = "sym", day: str = "day", value: str = "close") -> DataFrame:
    """Rows of the days on which every symbol of the panel has a value."""
    known = panel.where(F.col(value).isNotNull())
    symbols = known.agg(F.count_distinct(sym).alias("_n"))
    full = known.groupBy(day).agg(F.count_distinct(sym).alias("_k")).join(F.broadcast(symbols), F.col("_k") == F.col("_n")).select(day)  # one row
    return known.join(full, day, "left_semi")


def panel(bars: DataFrame, days: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every symbol on every day of the calendar, null where it has no bar. The calendar is bounded; each symbol explodes it."""
    known = sorted(r[0] for r in days.select("day").where("day is not null").distinct().collect())
    grid = symbols.select("sym").distinct().select("sym", F.explode(F.array(*[F.lit(d) for d in known])).alias("day")) if known else bars.select("sym", "day").limit(0)
    return grid.join(bars, ["sym", "day"], "left")


def report(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, for sinks that take one document a line."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def versions(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows with the time from which and until which they are a key's current version."""
    w = W.partitionBy(*key).orderBy(at)
    return df.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def synthetic_prices(spark: SparkSession, symbols: list[str], first: str, last: str) -> DataFrame:
    """sym, day, close: closed-form prices that depend on symbol and day alone."""
    s = spark.createDataFrame([(x,) for x in symbols], "sym string")
    s = s.withColumn("seed", F.aggregate(F.split("sym", ""), F.lit(0), lambda a, c: a + F.ascii(c)))
    x = s.select("sym", "seed", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    n = F.unix_date("day")
    return x.select("sym", "day", F.round(50 + F.col("seed") % 100 + 5 * F.sin((n + F.col("seed")) / 30.0) + (n - 10_000) * 0.002 * (1 + F.col("seed") % 3), 4).alias("close"))

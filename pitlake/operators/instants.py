"""Texts of many formats and zones to one instant in UTC.

Method: the text is brought to one canonical form by patterns; a local time is then matched as of zone-offset intervals, exploded to one
row per zone and four years: two matching intervals mean an ambiguous time, none a skipped one, one gives the offset at once. All zones there are take
part, whether a feed writes in them or a text names them, and all years: those before 1970 are one row, those after 2100 stand for a year with the same
calendar before it, since by then every zone's rules only repeat.

Everything stays in JVM expressions; the only join is against the exploded intervals, whose size is that of the zone database: some 600 zones x 33 rows.
"""

from __future__ import annotations

import datetime as dt
import functools
import importlib.resources
import pathlib
import struct
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and zone abbreviations of the US, Europe, Japan and Australia with their minutes from UTC.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_PATTERN = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
    "BST": 60, "IST": 60, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
}

#: Years that the exploded intervals cover one by one, and years of one row of them.
YEARS, CELL = (1970, 2100), 4
DAY_US = 86_400_000_000

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?\s*(.*)$"
_CANON = "#{y}|{m}|{d}|$4|$5|$6|$7|$8|$9"
#: Pattern and canonical form: kind, year, month, day, hour, minute, second, fraction, a or p, zone.
_FORMS = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt]|\s+)" + _TIME, "#" + _CANON.format(y="|$1", m="$2", d="$3")),
    (r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*()([A-Za-z+\-\[].*)?$", "#" + _CANON.format(y="|$1", m="$2", d="$3")),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+|[Tt])" + _TIME, "#" + _CANON.format(y="S|$3", m="$1", d="$2")),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s+|[Tt])" + _TIME, "#" + _CANON.format(y="|$3", m="$2", d="$1")),
    (rf"(?i)^(?:[a-z]+\.?,?\s+)?(\d{{1,2}})\s+({MONTH_PATTERN})\.?,?\s+(\d{{4}}),?\s+" + _TIME, "#" + _CANON.format(y="|$3", m="$2", d="$1")),
    (rf"(?i)^(?:[a-z]+\.?,\s+)?({MONTH_PATTERN})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+" + _TIME, "#" + _CANON.format(y="|$3", m="$1", d="$2")),
]
_EPOCH = r"^(\d{10}|\d{13}|\d{16})(?:[.,](\d+))?$"


def _changes(zone: str) -> tuple[list[int], bool]:
    """Seconds since 1970 of the changes that the zone database lists one by one, and whether a rule with changes holds after them."""
    for root in (*zoneinfo.TZPATH, None):
        try:
            at = importlib.resources.files("tzdata.zoneinfo").joinpath(zone) if root is None else pathlib.Path(root, zone)
            raw = at.read_bytes()
            break
        except (OSError, ModuleNotFoundError):
            continue
    else:
        return [], True
    sizes = lambda k: struct.unpack(">6l", raw[k + 20 : k + 44])
    utc, std, leap, times, kinds, chars = sizes(0)
    if raw[4:5] < b"2":
        return list(struct.unpack(f">{times}l", raw[44 : 44 + 4 * times])), True
    second = 44 + times * 5 + kinds * 6 + chars + leap * 8 + std + utc  # the block of the first version comes first
    times = sizes(second)[3]
    return list(struct.unpack(f">{times}q", raw[second + 44 : second + 44 + 8 * times])), b"," in raw.rstrip(b"\n").rsplit(b"\n", 1)[-1]


@functools.lru_cache(maxsize=None)
def offset_intervals(zone: str) -> list[tuple[int, int, int]]:
    """(local start, local end, offset) in seconds of each stretch of one offset up to the end of YEARS; the first and last are open-ended."""
    tz, epoch = zoneinfo.ZoneInfo(zone), dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    off = lambda t: int(tz.utcoffset((epoch + dt.timedelta(seconds=t)).astimezone(tz)).total_seconds())
    first, end = -5_000_000_000, int((dt.datetime(YEARS[1] + 1, 2, 1, tzinfo=dt.UTC) - epoch).total_seconds())
    listed, ruled = _changes(zone)
    listed = [t for t in listed if first < t < end]
    out, start, now = [], -(2**61), off(first)

    def change(t: int) -> None:
        nonlocal start, now
        nxt = off(t)
        if nxt != now:
            out.append((start, t + now, now))
            start, now = t + nxt, nxt

    for t in listed:
        change(t)
    # the rule's changes lie months apart, at quarters of an hour
    low = (listed[-1] if listed else -(2**31)) // 900
    while ruled and low * 900 < end:
        high = low + 60 * 96
        if off(high * 900) != now:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if off(mid * 900) != now else (mid, b)
            change(b * 900)
            high = b
        low = high
    out.append((start, 2**61, now))
    return out


@functools.lru_cache(maxsize=1)
def _cells() -> list[tuple[str, int, str]]:
    """Of all zones there are: the zone, CELL years, and the intervals that touch them by two days or less, as a text of numbers in microseconds.

    The cell before YEARS stands for all of time before it.
    """
    at = lambda cell: int((dt.datetime(cell * CELL, 1, 1, tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds())
    first, last, margin = YEARS[0] // CELL, YEARS[1] // CELL, 2 * 86_400
    bounds = [(first - 1, -(2**60), at(first) + margin)] + [(c, at(c) - margin, at(c + 1) + margin) for c in range(first, last + 1)]
    micros = lambda t: t * 1_000_000 if abs(t) < 2**60 else t
    out = []
    for zone in sorted(zoneinfo.available_timezones()):
        spans = [(s, e, f"{micros(s)},{micros(e)},{o * 1_000_000}") for s, e, o in offset_intervals(zone)]
        out += [(zone, cell, ";".join(t for s, e, t in spans if e > low and s < high)) for cell, low, high in bounds]
    return out


def exploded_intervals(spark: SparkSession) -> DataFrame:
    """One row per zone and CELL years with the intervals that touch them: tz_name, tz_cell, spans in microseconds."""
    x = spark.createDataFrame(_cells(), "tz_name string, tz_cell int, t string")
    number = lambda k: f"cast(split(p, ',')[{k}] as bigint)"
    return x.select("tz_name", "tz_cell", F.expr(f"transform(split(t, ';'), p -> named_struct('s', {number(0)}, 'e', {number(1)}, 'o', {number(2)}))").alias("spans"))


def _like_year() -> Column:
    """A year of YEARS with the same first weekday and the same length as the year ``_pl_y``."""
    same = {}
    for y in range(YEARS[1] - 40, YEARS[1] + 1):
        same[(dt.date(y, 1, 1).weekday(), int((dt.date(y + 1, 1, 1) - dt.date(y, 1, 1)).days))] = y
    table = F.create_map(*[F.lit(v) for (weekday, days), y in same.items() for v in (weekday * 1000 + days, y)])
    first, nxt = (F.expr(f"cast(try_make_timestamp_ntz(_pl_y + {k}, 1, 1, 0, 0, 0) as date)") for k in (0, 1))
    return F.try_element_at(table, F.weekday(first) * 1000 + F.coalesce(F.datediff(nxt, first), F.lit(365)))


def _number(part: str) -> Column:
    return F.expr(f"try_cast(nullif({part}, '') as int)")


def instants(df: DataFrame, text: str, feeds: DataFrame, feed: str = "feed", out: str = "instant_us") -> DataFrame:
    """df with a column ``out``: microseconds since 1970 UTC of the instant that the text names, else null.

    Null gives null: null or empty texts, words, impossible dates and times, unknown zones, and local times whose feed is unknown.
    A zone or offset in the text holds over the feed's; bare numbers of 10, 13 and 16 digits are seconds, milliseconds and microseconds;
    dates with slashes follow the feed's day_first (month first if that is null); finer digits are cut off; second 60 is the next minute's 0.
    A local time that occurs twice is the first, one that is skipped is read with the offset before. Rows, ties and further columns are
    kept as they are; helper columns have names beginning with ``_pl_`` and are dropped. An empty table gives an empty table.
    """
    spark = df.sparkSession
    fd = F.broadcast(  # a fixed dimension
        feeds.where(F.col("feed").isNotNull()).groupBy(F.col("feed").alias("_pl_feed")).agg(F.first("tz_name").alias("_pl_tz"), F.first("day_first").alias("_pl_df"))
    )
    spans = F.broadcast(exploded_intervals(spark).select(F.col("tz_name").alias("_pl_z"), F.col("tz_cell").alias("_pl_zy"), F.col("spans").alias("_pl_spans")))  # of the zone database's size

    canon = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    for pattern, form in _FORMS:
        canon = F.regexp_replace(canon, pattern, form)
    x = df.withColumn("_pl_c", canon).join(fd, df[feed] == F.col("_pl_feed"), "left")
    x = x.withColumn("_pl_p", F.when(F.col("_pl_c").startswith("##"), F.split("_pl_c", r"\|", -1)))
    month = lambda k: F.coalesce(
        _number(f"_pl_p[{k}]"), F.expr(f"nullif(array_position(array({','.join(repr(m) for m in MONTHS)}), lower(substring(_pl_p[{k}], 1, 3))), 0)")
    )
    swap = F.col("_pl_c").startswith("##S") & F.coalesce(F.col("_pl_df"), F.lit(False))
    hour = _number("_pl_p[4]")
    ap = F.lower(F.expr("_pl_p[8]"))
    x = x.select(
        "*",
        _number("_pl_p[1]").alias("_pl_y"),
        F.when(swap, _number("_pl_p[3]")).otherwise(month(2)).cast("int").alias("_pl_m"),
        F.when(swap, _number("_pl_p[2]")).otherwise(_number("_pl_p[3]")).alias("_pl_d"),
        F.when(ap == "", hour).when(hour.between(1, 12), hour % 12 + F.when(ap == "p", 12).otherwise(0)).alias("_pl_h"),
        _number("_pl_p[5]").alias("_pl_mi"),
        F.coalesce(_number("_pl_p[6]"), F.lit(0)).alias("_pl_s"),
        F.coalesce(F.expr("try_cast(nullif(rpad(substring(_pl_p[7], 1, 6), 6, '0'), '') as int)"), F.lit(0)).alias("_pl_f"),
        F.regexp_replace(F.expr("_pl_p[9]"), r"\s*\([^)]*\)$", "").alias("_pl_zone"),
    )
    # one zone text: offset first, else a name in brackets, else the name
    zone = F.col("_pl_zone")
    off = F.regexp_extract(zone, r"^(?:UTC|GMT|utc|gmt)?\s*([+\-]\d{1,2}(?::?\d{2})?(?::\d{2})?)(?:\[.*\])?$", 1)
    x = x.withColumn("_pl_off", off)
    x = x.withColumn("_pl_name", F.regexp_replace(F.regexp_extract(zone, r"^(?:[Zz](?=\[))?\[?([A-Za-z][A-Za-z0-9_/+\-]*)\]?$", 1), r"^$", ""))
    abbreviations = F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv])
    o = "_pl_off"
    digits = F.expr(f"replace(substring({o}, 2), ':', '')")
    oh = F.when(F.length(digits) <= 2, digits).otherwise(F.expr(f"substring(replace(substring({o}, 2), ':', ''), 1, length(replace(substring({o}, 2), ':', '')) - 2)"))
    om = F.when(F.length(digits) <= 2, F.lit("0")).otherwise(F.expr(f"right(replace(substring({o}, 2), ':', ''), 2)"))
    x = x.select("*", oh.alias("_pl_oh"), om.alias("_pl_om"))
    minutes = F.expr("try_cast(_pl_oh as int) * 60 + try_cast(_pl_om as int)")
    signed = F.when(F.expr("try_cast(_pl_om as int) < 60") & (minutes <= 18 * 60), F.when(F.col(o).startswith("-"), -minutes).otherwise(minutes))
    x = x.withColumn(
        "_pl_fixed",
        F.when(F.col(o) != "", signed.cast("bigint")).when(F.col("_pl_name") != "", F.element_at(abbreviations, F.upper("_pl_name")).cast("bigint")),
    )
    x = x.withColumn(
        "_pl_z1",
        F.when(zone == "", F.col("_pl_tz")).when(F.col("_pl_fixed").isNull() & (F.col("_pl_name") != ""), F.col("_pl_name")),
    )
    # the date is checked without a session zone
    date = F.expr("cast(try_make_timestamp_ntz(_pl_y, _pl_m, _pl_d, 0, 0, 0) as date)")
    x = x.withColumn(
        "_pl_local",
        F.when(
            F.col("_pl_h").between(0, 23) & F.col("_pl_mi").between(0, 59) & F.col("_pl_s").between(0, 60) & (F.col("_pl_y") > 0),
            F.unix_date(date).cast("bigint") * DAY_US + ((F.col("_pl_h") * 60 + F.col("_pl_mi")) * 60 + F.col("_pl_s")).cast("bigint") * 1_000_000 + F.col("_pl_f"),
        ),
    )
    # a year after all that are listed is looked up as one with the same calendar
    x = x.withColumn("_pl_year", F.when(F.col("_pl_y") > YEARS[1], _like_year()).otherwise(F.greatest("_pl_y", F.lit(YEARS[0] // CELL * CELL - 1))))
    apart = F.expr("datediff(cast(try_make_timestamp_ntz(_pl_y, 1, 1, 0, 0, 0) as date), cast(try_make_timestamp_ntz(_pl_year, 1, 1, 0, 0, 0) as date))").cast("bigint") * DAY_US
    x = x.withColumn("_pl_at", F.when(F.col("_pl_y") > YEARS[1], F.col("_pl_local") - apart).otherwise(F.col("_pl_local")))
    x = x.join(spans, (F.col("_pl_z1") == F.col("_pl_z")) & (F.floor(F.col("_pl_year") / CELL) == F.col("_pl_zy")), "left")
    x = x.withColumn("_pl_hit", F.expr("filter(_pl_spans, i -> _pl_at >= i.s and _pl_at < i.e)"))
    # two intervals: the earlier instant has the greater offset; none: the last interval that ended before
    from_spans = F.expr(
        "_pl_local - case when size(_pl_hit) >= 1 then array_max(transform(_pl_hit, i -> i.o)) else array_max(filter(_pl_spans, i -> i.e <= _pl_at)).o end"
    )
    n, frac = F.regexp_extract("_pl_c", _EPOCH, 1), F.regexp_extract("_pl_c", _EPOCH, 2)
    x = x.select("*", n.alias("_pl_n"), frac.alias("_pl_nf"))
    micro = F.expr("try_cast(_pl_n as bigint)")
    epoch = (
        F.when(F.length("_pl_n") == 10, micro * 1_000_000 + F.expr("cast(rpad(substring(_pl_nf, 1, 6), 6, '0') as bigint)"))
        .when(F.length("_pl_n") == 13, micro * 1_000 + F.expr("cast(rpad(substring(_pl_nf, 1, 3), 3, '0') as bigint)"))
        .when(F.length("_pl_n") == 16, micro)
    )
    instant = (
        F.when(F.col("_pl_n") != "", epoch)
        .when(F.col("_pl_fixed").isNotNull(), F.col("_pl_local") - F.col("_pl_fixed") * 60_000_000)
        .when((F.col(o) != ""), F.lit(None).cast("bigint"))
        .when(F.col("_pl_spans").isNotNull(), from_spans)
    )
    return x.select(*[df[c] for c in df.columns], instant.alias(out))

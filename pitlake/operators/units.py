"""Quantities recorded in different units, brought to one unit per kind.

A stated unit is read from its note by word patterns. Where a source states none, its history is segmented: the log10 of each value over the
level of the entity's nearest stated values is searched for changepoints, exactly, under a penalty (PELT). A segment's level says by which known
factor the source recorded there, and that factor is reversed for all of its facts: the segments decide.

Facts of one source, day and log level are one point of the history, with their number, sum and sum of squares, and the search runs over points. So a
source with a third of all facts is reduced before any shuffle by key, and a history is as long as its calendar, not as its number of rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.session import materialised

# Units by name with common unit and factor.
UNITS = {
    "USD": ("USD", 1), "USD thousand": ("USD", 1_000), "USD million": ("USD", 1_000_000), "USD billion": ("USD", 1_000_000_000),
    "fraction": ("basis point", 10_000), "percent": ("basis point", 100), "basis point": ("basis point", 1),
    "USD per share": ("US cent per share", 100), "US cent per share": ("US cent per share", 1),
}
#: Spellings (lower case, single spaces) of money magnitudes; the first that matches holds.
MAGNITUDES = [
    ("USD billion", r"billion|milliard|\bmrd\b|\bbn\b|\bbusd\b|\bmd\$|usd_bn|\$ ?b\b"),
    ("USD million", r"million|millones|\bmio\b|\bmn\b|\bmm\b|usd_mm|\bmusd\b|\$ ?mm?\b|\bm ?\$|\bm\b"),
    ("USD thousand", r"thousand|tausend|millier|\btsd\b|\bmiles\b|\(?000s?\)?|1[,.]000|\bk ?\$|usd_k|\bkusd\b|\$ ?k\b|\bk\b"),
    ("USD", r"usd|\$|dollar|unit|whole|us-dollar"),
]

#: log10 of the factors that a source may have recorded by: whole, thousand, million, billion.
SHIFTS = (0, 3, 6, 9)
#: Cost of one more segment, in squared log10 units: a stretch or a single fact parts from its neighbours where it lies off by more than the square root
#: of twice this, 1.7; a shift by a known factor is 3, usual growth far less.
PENALTY = 1.5
#: Log levels of one point: facts of one source and day this near to each other (1/16 of a decade) are searched as one.
LEVELS = 16



def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def _magnitude(plain: Column) -> Column:
    return F.coalesce(*[F.when(plain.rlike(pattern), F.lit(name)) for name, pattern in MAGNITUDES])


def with_note_unit(df: DataFrame, note: str, out: str) -> DataFrame:
    """df with the unit in a note such as `USD mn`, `(000s)` or `Mrd. USD`, else null."""
    return df.withColumn("_pl_note", _plain(F.col(note))).withColumn(out, _magnitude(F.col("_pl_note"))).drop("_pl_note")


def with_tag_unit(df: DataFrame, source: str, out: str) -> DataFrame:
    """df with the unit that was added to a source's name as [..] or #.., else null; additions after @ are versions."""
    tag = F.col("_pl_tag")
    kinds = [
        ("basis point", r"^(bps?|basis points?)$"), ("percent", r"^(%|pct|percent)$"), ("fraction", r"^(ratio|fraction)$"),
        ("US cent per share", r"^(c/share|cents?|usc/share)$"), ("USD per share", r"^(\$/share|usd_sh|usd/share)$"),
    ]
    marked = F.contains(F.col(source), F.lit("[")) | F.contains(F.col(source), F.lit("#"))  # most names have no addition to look for
    raw = F.when(marked, F.regexp_extract(source, r"(?:\[([^\]]*)\]|#(.*))\s*$", 0))
    df = df.withColumn("_pl_tag", F.nullif(F.regexp_replace(_plain(raw), r"^\[|\]$|^#(?:unit=)?", ""), F.lit("")))
    return df.withColumn(out, F.coalesce(*[F.when(tag.rlike(rx), F.lit(name)) for name, rx in kinds], _magnitude(tag))).drop("_pl_tag")


_NUMBER = re.compile(r"\d+(?:[.,\u00a0\u202f '’]\d+)*")
_PART = re.compile(r"[^\u00a0\u202f ]+")
_AFTER_MONEY = [
    ("USD billion", r"\)?\s*(?:billions?|milliards?|milliarden|mrd\b|bn\b|md\s?\$)"),
    ("USD million", r"\)?\s*(?:millions?|millionen|mio\b|mn\b|mm\b|m\s?\$|m\b)"),
    ("USD thousand", r"\)?\s*(?:thousand|tausend|tsd\b|milliers?|k\s?\$|k\b)"),
    ("USD", r"\)?\s*(?:outright|(?:us[- ]?)?dollars?\b|usd\b|\$)"),
]
_AFTER_MONEY = [(unit, re.compile(rx, re.I)) for unit, rx in _AFTER_MONEY]
_PERCENT = re.compile(r"\)?\s*(?:%|per\s?cent\b|percent\b|prozent\b|pour\s?cent\b)", re.I)
_BP = re.compile(r"\)?\s*(?:bps?\b|basis points?|basispunkte?|points? de base)", re.I)
_FRACTION = re.compile(r"\)?\s*(?:as a (?:fraction|share|ratio)|als anteil|en fraction|en proportion)", re.I)
_CENT = re.compile(r"\)?\s*(?:¢|(?:us[- ]?)?cents?\b)", re.I)
# What stands before a number to give its unit.
_MONEY_BEFORE, _FRACTION_BEFORE = ("$", "usd"), ("ratio of", "anteil von", "rapport de")


def _readings(token: str) -> set[float]:
    """The values that the digits may mean in English, German and French."""
    bare = re.sub(r"[\u00a0\u202f '’]", "", token)
    out = set()
    for mark, group in ((".", ","), (",", ".")):
        whole, _, rest = bare.replace(group, "").partition(mark)
        if mark not in rest:
            out.add(float(f"{whole}.{rest or 0}"))
    return out


def _stretches(text: str, want: float) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of digits that may give ``want``: spaces inside group thousands or part numbers, so a stretch is one part, or as many
    as the number has groups (one more or less if its integer part is all but a power of ten). Longest first."""
    groups = (len(f"{want:.0f}") + 2) // 3
    for m in _NUMBER.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
        for n in sorted({groups + 1, groups, groups - 1, 1}, reverse=True):
            if 0 < n <= len(parts):
                yield from ((parts[k][0], parts[k + n - 1][1]) for k in range(len(parts) - n + 1))


def _ends_with(text: str, stop: int, marks: tuple[str, ...]) -> bool:
    """Whether one of the marks ends before ``stop``, with signs, brackets and white space of any length between."""
    while stop and (text[stop - 1] in "-−(" or text[stop - 1].isspace()):
        stop -= 1
    return text[max(0, stop - max(map(len, marks))) : stop].lower().endswith(marks)


def text_unit(text: str | None, value: float | None, common: str | None) -> str | None:
    """The unit that the text gives with the number ``value``; None if it gives none there."""
    if text is None or value is None or not math.isfinite(value):
        return None
    want, tolerance = abs(value), 1e-9 * max(1.0, abs(value))
    for begin, stop in _stretches(text, want):
        if not any(abs(x - want) <= tolerance for x in _readings(text[begin:stop])):
            continue
        if common == "basis point":
            unit = "percent" if _PERCENT.match(text, stop) else "basis point" if _BP.match(text, stop) else "fraction" if _ends_with(text, begin, _FRACTION_BEFORE) or _FRACTION.match(text, stop) else None
        else:
            unit = ("US cent per share" if _CENT.match(text, stop) else None) if common == "US cent per share" else next((u for u, rx in _AFTER_MONEY[:3] if rx.match(text, stop)), None)
            if unit is None and (_ends_with(text, begin, _MONEY_BEFORE) or _AFTER_MONEY[-1][1].match(text, stop)):
                unit = "USD per share" if common == "US cent per share" else "USD"
        if unit:
            return unit
    return None


def claim_units(claims: DataFrame, sources: DataFrame, rec_id: str = "claim_id") -> DataFrame:
    """(rec_id, common_unit, common_value) of numeric claims whose unit is known, one row per distinct claim.

    The unit is the one added to numeric_source, else the source's declared unit, else the one that the text gives with that very number. Claims
    that are not numeric, or have a null or non-finite value or an unknown source, give no row; a null flag counts as false.
    Values are rounded half up to whole units; one that no bigint holds has a null common_value. Texts are read whole; only those of claims that no source states a unit for are sent to Python.
    """
    s = F.broadcast(  # a fixed dimension of sources
        sources.select(F.col("numeric_source").alias("_pl_base"), "declared_unit", F.col("common_unit")).dropDuplicates(["_pl_base"])
    )
    c = (
        claims.select(F.col(rec_id).alias("rec_id"), "text", "is_numeric", "numeric_value", "numeric_source")
        .where(F.col("is_numeric") & F.col("numeric_value").isNotNull() & ~F.isnan("numeric_value") & (F.abs("numeric_value") < float("inf")))
        .withColumn("_pl_base", F.trim(F.regexp_extract("numeric_source", r"^[^\[#@]+", 0)))
        .join(s, "_pl_base")
    )
    c = with_tag_unit(c, "numeric_source", "_pl_tagged").withColumn("_pl_unit", F.coalesce("_pl_tagged", "declared_unit"))

    @F.pandas_udf("string")
    def from_text(text: pd.Series, value: pd.Series, common: pd.Series) -> pd.Series:
        return pd.Series([text_unit(*x) for x in zip(text, value, common, strict=True)], dtype=object)

    # one pass: claims that a source states a unit for go by without their text
    said = from_text(F.when(F.col("_pl_unit").isNull(), F.col("text")), "numeric_value", "common_unit")
    out = c.withColumn("_pl_unit", F.coalesce("_pl_unit", said)).withColumn("_pl_factor", factor(F.col("_pl_unit"), F.col("common_unit"))).where("_pl_factor is not null")
    return out.select("rec_id", "common_unit", common_value(F.col("numeric_value"), F.col("_pl_factor")).alias("common_value")).distinct()


def factor(unit: Column, common: Column) -> Column:
    """What brings the unit to the common unit; null if it is unknown or of another kind."""
    table = lambda k: F.create_map(*[F.lit(v) for name, of in UNITS.items() for v in (name, of[k])])
    return F.when(F.try_element_at(table(0), unit) == common, F.try_element_at(table(1), unit))


def common_value(value: Column, factor: Column) -> Column:
    """The value in whole common units, rounded half up; null where no bigint holds it."""
    return F.round(F.try_multiply(value.try_cast("decimal(38,12)"), factor.cast("decimal(10,0)")), 0).try_cast("bigint")


def pelt(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """Exact penalised segmentation of points, each of n values with sum s1 and sum of squares s2, into stretches [a, b) of constant mean with squared error,
    by pruned optimal partitioning."""
    size = len(n)
    n, s1, s2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s1, s2))
    best, back, live = np.empty(size + 1), np.zeros(size + 1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    best[0] = -penalty
    for t in range(1, size + 1):
        total = s1[t] - s1[live]
        cost = best[live] + (s2[t] - s2[live]) - total * total / (n[t] - n[live])
        k = int(np.argmin(cost))
        best[t], back[t] = cost[k] + penalty, live[k]
        live = np.append(live[cost <= best[t]], t)
    out, t = [], size
    while t:
        out.append((int(back[t]), t))
        t = int(back[t])
    return out[::-1]


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points sorted by history and time to points with the shift of their segment; one history is held at a time."""
    held: list[pd.DataFrame] = []

    def settle(h: pd.DataFrame) -> pd.DataFrame:
        n, s1, s2 = (h[c].to_numpy(float) for c in ("n", "s1", "s2"))
        shift = np.zeros(len(h), dtype=np.int64)
        for a, b in pelt(n, s1, s2, PENALTY):
            level = s1[a:b].sum() / n[a:b].sum()  # below its reference by the factor recorded in
            shift[a:b] = min(SHIFTS, key=lambda k: abs(k + level))
        return h[["entity", "source", "day", "lev"]].assign(shift=shift)

    def same(x: pd.Series) -> np.ndarray:
        a, b = x.iloc[1:].reset_index(drop=True), x.iloc[:-1].reset_index(drop=True)
        return ((a == b) | (a.isna() & b.isna())).to_numpy(bool)

    for frame in frames:
        frame = pd.concat([*held, frame], ignore_index=True) if held else frame
        if not len(frame):
            continue
        cuts = [0, *(np.flatnonzero(~(same(frame["entity"]) & same(frame["source"]))) + 1).tolist(), len(frame)]
        done = [settle(frame.iloc[a:b]) for a, b in zip(cuts[:-2], cuts[1:-1], strict=True)]
        held = [frame.iloc[cuts[-2] :]]
        if done:
            yield pd.concat(done, ignore_index=True)
    if held:
        yield settle(pd.concat(held, ignore_index=True))


def history_units(facts: DataFrame, entity: str, source: str, fact_id: str, at: str, value: str, note: str) -> DataFrame:
    """(fact_id, common_unit, common_value) of each distinct fact with a value: money as recorded, brought to whole USD.

    A note that names a unit holds. Without one the fact takes the factor of its segment: its source's history, stated values too, is set against the level of
    the entity's nearest stated values in time (both sides alike if equally near; the median of all levels if its entity states none), the changepoint
    search parts it into segments, and a segment whose mean lies nearest to a known factor below its reference was recorded by that factor.
    Zero stays zero; null and non-finite values give no row; a value that no bigint holds in whole USD has a null common_value. Facts without a time count as
    of 1970. Null entities and sources are an entity and a source of their own.
    """
    names = ("USD", "USD thousand", "USD million", "USD billion")
    shift_of = F.create_map(*[F.lit(v) for kv in zip(names, map(float, SHIFTS), strict=True) for v in kv])
    v = F.col("value")
    f = with_note_unit(facts, note, "_pl_unit").select(
        F.col(fact_id).alias("fact"), F.col(entity).cast("string").alias("entity"), F.col(source).cast("string").alias("source"), F.coalesce(F.unix_date(F.col(at).cast("date")), F.lit(0)).alias("day"),
        F.col(value).cast("double").alias("value"), F.try_element_at(shift_of, F.col("_pl_unit")).alias("known"),
    ).where("value is not null and not isnan(value) and abs(value) < double('inf')").distinct()
    f = materialised(f.withColumn("lev", F.when(v != 0, F.floor(F.log10(F.abs(v)) * LEVELS).cast("int"))), "histories")  # made distinct once, read twice
    size = F.log10(F.abs(v))
    points = f.where("value <> 0").groupBy("entity", "source", "day", "lev", "known").agg(F.count("*").alias("n"), F.sum(size).alias("s1"), F.sum(size * size).alias("s2"))
    # the nearest stated levels before and after, within windows of one partitioning
    points = points.repartition("entity")
    stated = F.when(F.col("known").isNotNull(), F.col("n"))
    level = F.sum(F.col("s1") + F.col("known") * F.col("n")) / F.nullif(F.sum(stated), F.lit(0))
    days = points.groupBy("entity", "day").agg(level.alias("level"))
    overall = days.agg(F.percentile_approx("level", 0.5)).first()[0]  # one number
    pair = F.when(F.col("level").isNotNull(), F.struct("day", "level"))
    back, ahead = W.partitionBy("entity").orderBy("day"), W.partitionBy("entity").orderBy(F.desc("day"))
    days = days.select("entity", "day", F.last(pair, ignorenulls=True).over(back).alias("b"), F.last(pair, ignorenulls=True).over(ahead).alias("a"))
    before, after = F.col("day") - F.col("b.day"), F.col("a.day") - F.col("day")
    near = F.when(after.isNull() | (before < after), F.col("b.level")).when(before.isNull() | (after < before), F.col("a.level")).otherwise((F.col("a.level") + F.col("b.level")) / 2)
    days = days.select(F.col("entity").alias("_e"), F.col("day").alias("_d"), F.coalesce(near, F.lit(float(overall or 0.0))).alias("ref"))
    # histories with an unstated value alone need a search; the others are settled by their notes
    history = points.withColumn("open", F.max(F.col("known").isNull()).over(W.partitionBy("entity", "source"))).where("open")
    x = history.join(days, F.col("entity").eqNullSafe(F.col("_e")) & (F.col("day") == F.col("_d")))
    x = x.groupBy("entity", "source", "day", "lev").agg(
        F.sum("n").alias("n"), F.sum(F.col("s1") - F.col("n") * F.col("ref")).alias("s1"), F.sum(F.col("s2") - 2 * F.col("ref") * F.col("s1") + F.col("n") * F.col("ref") * F.col("ref")).alias("s2")
    )
    # a stated number of partitions, which isn't merged for being few bytes: the search is bound by its work
    x = x.repartition(facts.sparkSession.sparkContext.defaultParallelism, "entity", "source").sortWithinPartitions("entity", "source", "day", "lev")
    found = x.mapInPandas(_segments, "entity string, source string, day int, lev int, shift int")
    found = found.select(F.col("entity").alias("_e"), F.col("source").alias("_s"), F.col("day").alias("_d"), F.col("lev").alias("_l"), "shift")
    on = F.col("entity").eqNullSafe(F.col("_e")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("day") == F.col("_d")) & (F.col("lev") == F.col("_l"))
    shift = F.coalesce(F.col("known").cast("int"), F.col("shift"), F.lit(0))
    out = f.where("known is not null or value = 0").withColumn("shift", F.lit(0)).unionByName(f.where("known is null and value <> 0").join(found, on, "left").select(*f.columns, "shift"))
    whole = F.element_at(F.create_map(*[F.lit(v) for k in SHIFTS for v in (k, 10**k)]), shift)
    return out.select(F.col("fact").alias(fact_id), F.lit("USD").alias("common_unit"), common_value(v, whole).alias("common_value"))

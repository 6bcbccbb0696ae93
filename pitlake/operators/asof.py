"""As-of joins, calendar entry and the guard against data from after a cutoff."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, slot: Column | None = None) -> DataFrame:
    """left with the values of the last right row of its keys at or before (strict: before) its time; null if there is none.

    Both sides are united and sorted once; no row meets another. Of right rows at one time the greatest values stand. Nulls among the values are values of
    their row: the whole row is taken. Left rows with a null time or key have no match and stay.

    slot, an expression of the column ``_t`` (the time), splits long keys: each slot is sorted by itself, and what a key's earlier slots end with is carried
    into it, so that a key with a third of all rows spreads over its slots.
    """
    pack = F.struct(*[F.col(v).alias(v) for v in values])
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_t"), pack.alias("_v"), F.lit(0 if not strict else 1).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    le = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_t"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(1 if not strict else 0).alias("_side"), F.struct(*left.columns).alias("_row"))
    ks = [f"_k{i}" for i in range(len(keys))]
    r = r.where("_t is not null")
    if slot is not None:
        r, le = r.withColumn("_slot", slot), le.withColumn("_slot", slot)
        ends = r.groupBy(*ks, "_slot").agg(F.max(F.struct("_t", "_v")).alias("_end")).unionByName(le.select(*ks, "_slot").distinct().withColumn("_end", F.lit(None)), allowMissingColumns=True)
        ends = ends.groupBy(*ks, "_slot").agg(F.max("_end").alias("_end"))
        carried = ends.withColumn("_c", F.last("_end", True).over(W.partitionBy(*ks).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))).where("_c is not null")
        r = r.unionByName(carried.select(*ks, F.col("_c._t").alias("_t"), F.col("_c._v").alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_row"), "_slot"))
        ks = [*ks, "_slot"]
    w = W.partitionBy(*ks).orderBy(F.asc_nulls_first("_t"), "_side", F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
    both = r.unionByName(le).withColumn("_m", F.last("_v", True).over(w)).where("_row is not null")
    return both.select("_row.*", *[F.col(f"_m.{v}").alias(v) for v in values])


def calendar(days: DataFrame, day: str = "day") -> DataFrame:
    """(day, idx) of the distinct days, idx from 0: one row for each calendar day."""
    return days.select(day).where(F.col(day).isNotNull()).distinct().withColumn("idx", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(day)) - 1)


def entry_day(events: DataFrame, accepted: str, cal: DataFrame, close_hour: int = 13, out: str = "entry") -> DataFrame:
    """events with the first calendar day on which an event accepted at that UTC time can be acted on: its day before close_hour, else the next there is.

    The calendar's gaps are filled by an as-of lookup, so events join by day alone; the calendar has one row for each day and is broadcast only if small.
    An event from before the calendar, however long, is given its first day, one from after it none.
    """
    first = cal.agg(F.min("day")).first()[0]  # one day
    before = F.lag("day").over(W.partitionBy(F.lit(0)).orderBy("day"))
    # each calendar day stands for itself and for the days without one before it
    days = cal.select(F.col("day").alias("_d"), F.coalesce(F.date_add(before, 1), "day").alias("_p"))
    filled = days.select(F.explode(F.sequence("_p", "_d")).alias("_from"), F.col("_d").alias("_to"))
    at = F.date_add(F.col(accepted).cast("date"), (F.hour(accepted) >= close_hour).cast("int"))
    e = events.withColumn("_at", at)
    e = e.join(filled, e["_at"] == filled["_from"], "left")
    return e.withColumn(out, F.coalesce("_to", F.when(F.col("_at") < F.lit(first), F.lit(first)))).drop("_at", "_from", "_to")


class LookaheadError(ValueError):
    """Data from after the active cutoff was asked for."""


_cutoff: ContextVar[object | None] = ContextVar("pitlake_cutoff", default=None)


@contextmanager
def as_of(cutoff: object) -> Iterator[object]:
    """Within it, known() leaves nothing from after the cutoff. Scopes nest; threads and tasks have their own."""
    token = _cutoff.set(cutoff)
    try:
        yield cutoff
    finally:
        _cutoff.reset(token)


def known(df: DataFrame, time: str, strict: bool = False) -> DataFrame:
    """df up to (strict: before) the active cutoff; df itself outside a scope. The filter reaches the scan."""
    cutoff = _cutoff.get()
    if cutoff is None:
        return df
    return df.where(F.col(time) < F.lit(cutoff) if strict else F.col(time) <= F.lit(cutoff))


def guarded(df: DataFrame, time: str, source: str) -> DataFrame:
    """df, whose execution fails if any row is from after the active cutoff: the check is part of the plan and never filters."""
    cutoff = _cutoff.get()
    if cutoff is None:
        return df
    return df.withColumn(time, F.when(F.col(time) > F.lit(cutoff), F.raise_error(F.concat(F.lit(f"LookaheadError: {source} gave "), F.col(time).cast("string")))).otherwise(F.col(time)))

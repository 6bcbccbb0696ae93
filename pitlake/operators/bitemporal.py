"""Attributes as known at event time, by bitemporal rectangles.

Each entity's plane of valid time x recorded time is split into disjoint rectangles, in each of which one fact version is the current one:
the known fact with the latest valid start at or before the valid time. Rectangles are indexed by a grid of several cell widths, so that each
covers a bounded number of cells; an event is a point, which looks at one cell of each width.

Facts are first reduced to one per entity, valid start and recorded day, then swept within blocks of recorded time: what is current when a block
begins is carried into it. An entity's blocks are those in which it has facts, each reaching to the next, so that a date as far off as the year 9999, as
some tables write for "open", is one block more and not thousands. So no task ever holds one entity's whole history, and a hot entity's events spread over cells and salts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.session import materialised

#: Days in a block of the sweep. log2 of the cell widths in days; each rectangle takes the first width at which it spans at most SPAN cells, or the last,
#: which holds all of time in two cells.
BLOCK_DAYS, LEVELS, SPAN, SALTS = 1024, (6, 10, 14, 31), 17, 4
#: The end of either axis, after every date there is; open ends reach to it.
OPEN = (1 << 31) - 1


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by entity, block, recorded day and valid start, the carried ones first, to rectangles; one block is held at a time."""
    out: list[tuple] = []
    key, block_end, starts, state = None, 0, [], {}

    def close(valid: int, until: int) -> None:
        """Ends the rectangle that begins at this valid start."""
        version, since = state[valid]
        k = bisect.bisect_right(starts, valid)
        if until > since:
            out.append((key[0], version, valid, starts[k] if k < len(starts) else OPEN, since, until))

    def flush() -> None:
        for valid in starts:
            close(valid, block_end)

    cols = ["entity", "fact", "v0", "v1", "r0", "r1"]
    for frame in frames:
        for entity, block, r, v, fact, b0, b1 in zip(
            frame["entity"].tolist(), frame["block"].tolist(), frame["r"].tolist(), frame["v"].tolist(), frame["fact"].tolist(), frame["b0"].tolist(), frame["b1"].tolist(), strict=True
        ):
            if key != (entity, block):
                if key is not None:
                    flush()
                key, block_end, starts, state = (entity, block), b1, [], {}
            since = max(r, b0)
            if v in state:
                close(v, since)
            else:
                k = bisect.bisect_left(starts, v)
                if k:  # the rectangle before is cut at v from now on
                    before = starts[k - 1]
                    close(before, since)
                    state[before] = (state[before][0], since)
                starts.insert(k, v)
            state[v] = (fact, since)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=cols)
            out.clear()
    if key is not None:
        flush()
    yield pd.DataFrame(out, columns=cols)


def rectangles(facts: DataFrame, entity: str, valid_from: str, recorded_on: str, fact_id: str, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Disjoint current-version rectangles (entity, fact, v0, v1, r0, r1), half-open, in days since 1970; an open end is OPEN.

    A fact is known from the day after its recorded day. Of facts with the same entity, valid start and recorded day the smallest fact_id is kept;
    a later recorded day supersedes an earlier one. Facts with a null entity, valid start, recorded day or id can't be placed and give none.
    """
    f = (
        facts.select(F.col(entity).alias("entity"), F.unix_date(F.col(valid_from).cast("date")).alias("v"), (F.unix_date(F.col(recorded_on).cast("date")) + 1).alias("r"), F.col(fact_id).alias("fact"))
        .dropna()
        .groupBy("entity", "v", "r")
        .agg(F.min("fact").alias("fact"))
        .withColumn("block", F.floor(F.col("r") / block_days).cast("int"))
    )
    f = materialised(f, "facts")  # reduced once, read three times
    # an entity's blocks in their order; each reaches to the next, the last one to the end of time
    w = W.partitionBy("entity").orderBy("block")
    blocks = f.select("entity", "block").distinct()
    blocks = blocks.select("entity", "block", F.row_number().over(w).alias("pos"), (F.col("block") * block_days).alias("b0"), F.coalesce(F.lead("block").over(w) * block_days, F.lit(OPEN)).alias("b1"))
    placed = f.join(blocks, ["entity", "block"])
    # the last version in each block is carried to the entity's following blocks, up to the one with the next version, or its last
    last = placed.groupBy("entity", "v", "pos").agg(F.max_by("fact", "r").alias("fact"))
    nxt = F.lead("pos").over(W.partitionBy("entity", "v").orderBy("pos"))
    ends = blocks.groupBy("entity").agg(F.max("pos").alias("top"))
    carried = (
        last.withColumn("next", nxt).join(ends, "entity").withColumn("until", F.coalesce("next", "top")).where("until > pos")
        .select("entity", F.explode(F.sequence(F.col("pos") + 1, F.col("until"))).alias("pos"), "v", "fact", F.lit(-(1 << 20)).alias("r"))
        .join(blocks, ["entity", "pos"])
    )
    columns = ["entity", "block", "r", "v", "fact", "b0", "b1"]
    rows = carried.select(*columns).unionByName(placed.select(*columns))
    types = dict(f.dtypes)
    # carried rows sort by valid start, which cuts the rectangles at once; rows of one recorded day too
    return (
        rows.repartition("entity", "block")
        .sortWithinPartitions("entity", "block", "r", "v")
        .mapInPandas(_sweep, f"entity {types['entity']}, fact {types['fact']}, v0 int, v1 int, r0 int, r1 int")
    )


def _level(low: Column, high: Column) -> Column:
    level = F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        level = F.when(F.shiftright(high - 1, k) - F.shiftright(low, k) < SPAN, F.lit(k)).otherwise(level)
    return level


def _shift(x: Column, k: Column) -> Column:
    """x >> k for a k that is a column of LEVELS."""
    out = F.lit(None).cast("int")
    for level in LEVELS:
        out = F.when(k == level, F.shiftright(x, level)).otherwise(out)
    return out


def locate(events: DataFrame, entity: str, recorded: Column, rects: DataFrame, valid: Column | None = None, fact_id: str = "fact_id") -> DataFrame:
    """events with the column fact_id of the rectangle that holds the point (valid, recorded), both dates; events in no rectangle are left out.

    ``valid`` of None means the latest valid time there is: then only rectangles open on the valid axis can hold the point, and the others are pruned.
    Events with a null entity or date are in no rectangle. Repeated events stay repeated; columns keep their names, helpers begin with ``_pl_``.
    """
    r = rects.where(F.col("v1") == OPEN) if valid is None else rects
    r = r.withColumn("lr", _level(F.col("r0"), F.col("r1"))).withColumn("cr", F.explode(F.sequence(_shift(F.col("r0"), F.col("lr")), _shift(F.col("r1") - 1, F.col("lr")))))
    if valid is None:
        r = r.withColumn("lv", F.lit(0)).withColumn("cv", F.lit(0))
    else:
        r = r.withColumn("lv", _level(F.col("v0"), F.col("v1"))).withColumn("cv", F.explode(F.sequence(_shift(F.col("v0"), F.col("lv")), _shift(F.col("v1") - 1, F.col("lv")))))
    r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = events.withColumn("_pl_r", F.unix_date(recorded.cast("date"))).withColumn("_pl_v", F.lit(0) if valid is None else F.unix_date(valid.cast("date")))
    e = e.where(F.col("_pl_r").isNotNull() & F.col("_pl_v").isNotNull() & F.col(entity).isNotNull())
    e = e.withColumn("_pl_salt", F.pmod(F.xxhash64(*events.columns), F.lit(SALTS)).cast("int"))
    levels = F.array(*[F.lit(k) for k in LEVELS])
    e = e.withColumn("_pl_lr", F.explode(levels))
    e = e.withColumn("_pl_lv", F.explode(levels)) if valid is not None else e.withColumn("_pl_lv", F.lit(0))
    e = e.withColumn("_pl_cr", _shift(F.col("_pl_r"), F.col("_pl_lr"))).withColumn("_pl_cv", F.lit(0) if valid is None else _shift(F.col("_pl_v"), F.col("_pl_lv")))
    r = r.select(*[F.col(c).alias(f"_pl_r_{c}") for c in r.columns])
    on = (
        (e[entity] == r["_pl_r_entity"]) & (F.col("_pl_salt") == F.col("_pl_r_salt")) & (F.col("_pl_lr") == F.col("_pl_r_lr")) & (F.col("_pl_lv") == F.col("_pl_r_lv"))
        & (F.col("_pl_cr") == F.col("_pl_r_cr")) & (F.col("_pl_cv") == F.col("_pl_r_cv")) & (F.col("_pl_r") >= F.col("_pl_r_r0")) & (F.col("_pl_r") < F.col("_pl_r_r1"))
    )
    if valid is not None:
        on = on & (F.col("_pl_v") >= F.col("_pl_r_v0")) & (F.col("_pl_v") < F.col("_pl_r_v1"))
    return e.join(r, on).select(*[e[c] for c in events.columns], F.col("_pl_r_fact").alias(fact_id))

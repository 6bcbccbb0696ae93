"""Records matched with the nearest record in time of the same entity, within a tolerance.

Both tables are repartitioned by entity and time slot, sorted within partitions, and merged by a two-pointer iterator that holds only the
neighbouring right records: the last one passed, and those of the slot still to come are read as they stream by. A slot's right side has a halo of
one tolerance on either side, so that slots are independent, and an entity with a third of all rows spreads over all its slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SLOT_US = 86_400_000_000
_NONE = np.iinfo(np.int64).min


def _merge(tolerance: int, right_type: pa.DataType):
    """The iterator of one sorted partition: batches of (entity, slot, ts, left, tag, key, rid), right rows of one time before left rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, slot = None, None  # of the last row seen
        passed: tuple[int, object] | None = None  # the last right record: time, id
        waiting: list[tuple[np.ndarray, pa.Table, np.ndarray, pa.Array]] = []  # left records since then, which wait for the next right one

        def settle(times: np.ndarray, rows: pa.Table, pt: np.ndarray, pid: pa.Array, nt: np.ndarray, nid: pa.Array) -> pa.RecordBatch | None:
            """Of the right record before and the one after the nearer, the earlier of two equally near; none beyond the tolerance."""
            back = np.where(pt == _NONE, tolerance + 1, times - np.where(pt == _NONE, times, pt))
            ahead = np.where(nt == _NONE, tolerance + 1, np.where(nt == _NONE, times, nt) - times)
            take_back, keep = back <= ahead, np.minimum(back, ahead) <= tolerance
            if not keep.any():
                return None
            ids = pc.if_else(pa.array(take_back), pid, nid).filter(pa.array(keep))
            rows = rows.filter(pa.array(keep))
            return pa.RecordBatch.from_arrays([rows.column("tag").combine_chunks(), rows.column("key").combine_chunks(), ids], names=["tag", "key", "rid"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            e, s = t.column("entity").combine_chunks(), t.column("slot").to_numpy()
            ts, left = t.column("ts").to_numpy(), t.column("left").to_numpy()
            new = np.empty(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | pc.not_equal(e[1:], e[:-1]).to_numpy(zero_copy_only=False)
            new[0] = entity is None or s[0] != slot or e[0].as_py() != entity
            group = np.cumsum(new) - (0 if new[0] else 1)  # from -1 or 0: the group of each row in this batch
            group -= group[0]
            rights = np.flatnonzero(~left)
            # of several right records at one time the first, which has the smallest id, stands for all
            if len(rights) > 1:
                same = np.concatenate([[False], (ts[rights[1:]] == ts[rights[:-1]]) & (group[rights[1:]] == group[rights[:-1]])])
                rights = rights[~same]
            if len(rights) and passed is not None and not new[0] and group[rights[0]] == 0 and ts[rights[0]] == passed[0]:
                rights = rights[1:]
            rid = t.column("rid").combine_chunks()
            # those that wait from earlier batches: settled by the first right record of their group, or by its end
            first = next((int(r) for r in rights[:1] if group[r] == 0 and not new[0]), None)
            if waiting and (new[0] or group[-1] > 0 or first is not None):
                nt = _NONE if first is None else int(ts[first])
                nid = None if first is None else rid[first].as_py()
                for times, rows, pt, pid in waiting:
                    out = settle(times, rows, pt, pid, np.full(len(times), nt), pa.array([nid] * len(times), right_type))
                    if out is not None:
                        yield out
                waiting = []
            if new[0]:
                passed = None
            lefts = np.flatnonzero(left)
            if len(lefts):
                k = np.searchsorted(rights, lefts)
                has_back = k > 0
                b = np.where(has_back, rights[np.maximum(k - 1, 0)] if len(rights) else 0, 0)
                has_back &= group[b] == group[lefts]
                has_ahead = k < len(rights)
                a = np.where(has_ahead, rights[np.minimum(k, len(rights) - 1)] if len(rights) else 0, 0)
                has_ahead &= group[a] == group[lefts]
                pt, nt = np.where(has_back, ts[b], _NONE), np.where(has_ahead, ts[a], _NONE)
                pid = pc.if_else(pa.array(has_back), rid.take(pa.array(b)), pa.scalar(None, right_type))
                nid = pc.if_else(pa.array(has_ahead), rid.take(pa.array(a)), pa.scalar(None, right_type))
                if passed is not None:  # carried over from the batch before
                    carried = ~has_back & (group[lefts] == 0)
                    pt = np.where(carried, passed[0], pt)
                    pid = pc.if_else(pa.array(carried), pa.scalar(passed[1], right_type), pid)
                rows, times = t.select(["tag", "key"]).take(pa.array(lefts)), ts[lefts]
                open_end = ~has_ahead & (group[lefts] == group[-1])
                if (~open_end).any():
                    m = pa.array(~open_end)
                    out = settle(times[~open_end], rows.filter(m), pt[~open_end], pid.filter(m), nt[~open_end], nid.filter(m))
                    if out is not None:
                        yield out
                if open_end.any():
                    m = pa.array(open_end)
                    waiting.append((times[open_end], rows.filter(m).combine_chunks(), pt[open_end], pid.filter(m)))
            if len(rights) and group[rights[-1]] == group[-1]:
                passed = (int(ts[rights[-1]]), rid[int(rights[-1])].as_py())
            elif group[-1] > 0:
                passed = None
            entity, slot = e[len(e) - 1].as_py(), s[-1]
            # a right record further off than the tolerance settles nothing: what lies so far back needs none
            horizon = int(ts[-1]) - tolerance
            if waiting and int(waiting[0][0].max()) < horizon:
                old = [w for w in waiting if int(w[0].max()) < horizon]
                waiting = [w for w in waiting if int(w[0].max()) >= horizon]
                for times, rows, pt, pid in old:
                    out = settle(times, rows, pt, pid, np.full(len(times), _NONE), pa.array([None] * len(times), right_type))
                    if out is not None:
                        yield out
        for times, rows, pt, pid in waiting:
            out = settle(times, rows, pt, pid, np.full(len(times), _NONE), pa.array([None] * len(times), right_type))
            if out is not None:
                yield out

    return run


def nearest(
    left: DataFrame, right: DataFrame, tolerance_us: int, left_tag: Column, left_key: Column, left_entity: Column, left_us: Column, right_id: Column, right_entity: Column, right_us: Column,
    tag: str = "rec_table", key: str = "rec_id", found: str = "bar_id", slot_us: int = SLOT_US,
) -> DataFrame:
    """(tag, key, found) of each left record and its nearest right record of the entity, at most tolerance_us away, the limit included.

    Of two right records equally near the earlier is taken, of several at one time the one with the smallest id. Left records with a null entity or time,
    or nothing near, give no row; repeated left records (same tag, key, entity and time) give one. Times are microseconds; a slot is never shorter than the
    tolerance. Only the columns named are read. Empty tables on either side give an empty result.
    """
    slot_us = max(slot_us, tolerance_us + 1)
    r = right.select(right_entity.alias("entity"), right_us.cast("bigint").alias("ts"), right_id.alias("rid")).dropna()
    low, high = (F.expr(f"cast((ts {sign} {tolerance_us}L - pmod(ts {sign} {tolerance_us}L, {slot_us}L)) div {slot_us}L as bigint)") for sign in "-+")
    mine = F.expr(f"cast((ts - pmod(ts, {slot_us}L)) div {slot_us}L as bigint)")
    # few right records lie near a slot's end and go to two slots
    r = r.withColumn("slot", F.explode(F.sequence(low, high)))
    kind = dict(r.dtypes)["rid"]
    x = left.select(left_tag.alias("tag"), left_key.alias("key"), left_entity.alias("entity"), left_us.cast("bigint").alias("ts")).where("entity is not null and ts is not null")
    key_kind, tag_kind = dict(x.dtypes)["key"], dict(x.dtypes)["tag"]
    x = x.withColumn("slot", mine)
    rows = x.select("entity", "slot", "ts", F.lit(True).alias("left"), "tag", "key", F.lit(None).cast(kind).alias("rid")).unionByName(
        r.select("entity", "slot", "ts", F.lit(False).alias("left"), F.lit(None).cast(tag_kind).alias("tag"), F.lit(None).cast(key_kind).alias("key"), "rid")
    )
    out = rows.repartition("entity", "slot").sortWithinPartitions("entity", "slot", "ts", "left", "rid", "tag", "key").mapInArrow(
        _merge(tolerance_us, to_arrow_type(r.schema["rid"].dataType)), f"tag {tag_kind}, key {key_kind}, rid {kind}"
    )
    return out.select(F.col("tag").alias(tag), F.col("key").alias(key), F.col("rid").alias(found)).distinct()

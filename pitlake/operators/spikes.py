"""Implausible spikes, stuck values and impossible readings in series of bars.

Method: phase-space thresholding. A bar is a point of three coordinates: its close's deviation from the closes around it, its first difference (from the
last close before) and its second difference (that and the one to the first close after). A series' ellipsoid has the robust scale of each coordinate times
the universal threshold as axes. Bars outside are flagged, the scales are taken anew without them, and so on until none is flagged any more. Runs of two and
three closes are then points like single closes, and whatever lies outside the last ellipsoid is a candidate. The exact rule of usual moves is asked of
candidates alone; the axis of the first difference is kept within its departure, so that no case is lost. Zero-difference runs and bounds catch other faults.

One range shuffle by series and time puts bars in order; a long series spreads over many partitions. Rows near a partition's ends, whose neighbours
lie in the next one, go on to a second, small pass. Usual moves and volumes are exact medians, found by counting (see exact_quantiles). The flagging runs on
each series' points counted by cells of 1/8 of a power of two in each coordinate, so that a series of any length is a bounded number of cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.functions.quantiles import exact_quantiles
from pitlake.session import materialised

# Fixed values of the rule.
USUAL_MOVES, VOLUME_TIMES, RUN, STUCK = 10.0, 20.0, 3, 6
#: Robust scale of a normal value from its median deviation.
MAD = 1.4826
#: Cells per power of two of a coordinate, and the cell of zero.
CELLS, ZERO = 8, -32_000
#: Bars in one partition of the ordered series; bounds a task's memory.
PARTITION_ROWS = 250_000

_RAW = "series string, ts bigint, id {id}, o double, h double, l double, c double, v double, emit boolean"
#: The closes before (m) and after (p) that are known, the nearest first, and the cells of the bar's point.
_CLOSES = ("m1", "m2", "m3", "p1", "p2", "p3")
_OUT = ", ".join(f"{k} double" for k in _CLOSES) + ", b0 short, b1 short, b2 short, hard boolean, zone boolean"


def _edges(c_ok: np.ndarray) -> tuple[int, int]:
    """(rows whose neighbours before may lie in the partition before, rows that these need here): both from the start."""
    known = np.cumsum(c_ok)

    def after(k: int) -> int:
        base = known[k - 1] if k else 0
        j = int(np.searchsorted(known, base + RUN))
        return min(len(c_ok), max(k + STUCK - 1, j + 1))

    edge = after(0)
    return edge, after(edge)


def _cell(d: np.ndarray) -> np.ndarray:
    d = np.abs(d)
    return np.where(d > 0, np.clip(np.floor(np.log2(np.where(d > 0, d, 1.0)) * CELLS), ZERO + 1, -ZERO), ZERO).astype(np.int16)


def _features(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Of each bar of one ordered series: the closes around it, the cells of its phase-space point, and the faults that need no scale."""
    n = len(c)
    ok = np.flatnonzero(~np.isnan(c))
    near = np.full((2 * RUN + 1, n), np.nan)  # the RUN closes before, its own and the RUN after
    padded = np.concatenate([np.full(RUN, np.nan), c[ok], np.full(RUN, np.nan)])
    for j in range(2 * RUN + 1):
        near[j, ok] = padded[j : j + len(ok)]
    out = {f"m{k}": near[RUN - k] for k in range(1, RUN + 1)} | {f"p{k}": near[RUN + k] for k in range(1, RUN + 1)}
    with np.errstate(all="ignore"):
        others = np.delete(near, RUN, axis=0)
        known = ~np.isnan(others)
        level = np.where(known, others, 0.0).sum(axis=0) / known.sum(axis=0)
        first, last = c / near[RUN - 1] - 1, c / near[RUN + 1] - 1
        for k, d in enumerate((c / level - 1, first, first + last)):
            out[f"b{k}"] = _cell(d)
        hard = (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0) | (v < 0) | (h < low) | (o < low) | (o > h) | (c < low) | (c > h)
        still = (o[1:] == o[:-1]) & (c[1:] == c[:-1]) & (v[1:] == v[:-1]) & (v[1:] != 0)
    starts = np.flatnonzero(np.concatenate([[True], ~still]))
    lengths = np.diff(np.append(starts, n))
    out["hard"] = hard | np.repeat(lengths >= STUCK, lengths)
    return out


def _pass(last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The function of one ordered partition. last: there is one partition, so that no neighbour lies elsewhere."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        whole = pd.concat(held, ignore_index=True)
        series, ts, ids = whole["series"].to_numpy(), whole["ts"].to_numpy(), whole["id"].to_numpy()
        again = np.concatenate([[False], (series[1:] == series[:-1]) & (ts[1:] == ts[:-1]) & (ids[1:] == ids[:-1])])
        if again.any():  # repeated deliveries; a zone and its neighbour never share a bar
            whole = whole[~again].reset_index(drop=True)
            series = whole["series"].to_numpy()
        cuts = [0, *(np.flatnonzero(series[1:] != series[:-1]) + 1).tolist(), len(whole)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = whole.iloc[a:b]
            columns = [part[x].to_numpy(dtype=float, na_value=np.nan) for x in "ohlcv"]
            scored = part.assign(zone=False, **_features(*columns))
            emit, ok = part["emit"].to_numpy(dtype=bool), ~np.isnan(columns[3])
            edge, zone = np.zeros(b - a, dtype=bool), np.zeros(b - a, dtype=bool)
            if not last and k == 0:
                e, z = _edges(ok)
                edge[:e], zone[:z] = True, True
            if not last and k == len(cuts) - 2:
                e, z = _edges(ok[::-1])
                edge[len(edge) - e :], zone[len(zone) - z :] = True, True
            if (emit & ~edge).any():  # done: high and low are spent
                yield scored[emit & ~edge].assign(ts=0, h=np.nan, l=np.nan)
            if zone.any():
                yield scored[zone].assign(zone=True, emit=(emit & edge)[zone])

    return run


def _partitions(spark: SparkSession, rows: int) -> int:
    return max(math.ceil(rows / PARTITION_ROWS), 1)


def placed_bars(bars: DataFrame, series: str, at: str, bar_id: str, prices: tuple[str, str, str, str], volume: str, partitions: int | None = None) -> DataFrame:
    """Each distinct bar with the closes around it and its cells, written to the shared folder, as in _RAW and _OUT. Bars without a series, time or id are left out."""
    spark = bars.sparkSession
    kind = dict(bars.dtypes)[bar_id]
    clean = lambda x: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    raw = bars.select(
        F.col(series).cast("string").alias("series"), F.unix_micros(F.col(at).cast("timestamp")).alias("ts"), F.col(bar_id).alias("id"),
        *[clean(p).alias(x) for p, x in zip((*prices, volume), "ohlcv", strict=True)], F.lit(True).alias("emit"),
    ).where("series is not null and ts is not null and id is not null")
    schema = f"{_RAW.format(id=kind)}, {_OUT}"
    n = partitions or max(_partitions(spark, bars.count()), spark.sparkContext.defaultParallelism)
    parts = []
    while True:
        ordered = raw.repartitionByRange(n, "series", "ts") if n > 1 else raw.coalesce(1)
        done = materialised(ordered.sortWithinPartitions("series", "ts", "id").mapInPandas(_pass(n == 1), schema), "spikes")
        parts.append(done.where("not zone"))
        if n == 1:
            break
        raw = done.where("zone").select(*raw.columns)
        zone_rows = raw.count()
        n = min(_partitions(spark, zone_rows), max(1, n // 2))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ellipsoids(widen: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cells (series, b0, b1, b2, k), sorted by series, to the axes of each series' last ellipsoid; one series' cells are held at a time."""

    def middle(size: np.ndarray, k: np.ndarray) -> float:
        order = np.argsort(size, kind="stable")
        return float(size[order][np.searchsorted(np.cumsum(k[order]), k.sum() / 2)])

    def settle(cells: np.ndarray, k: np.ndarray) -> tuple[float, float, float]:
        size = np.where(cells == ZERO, 0.0, np.exp2((cells + 0.5) / CELLS))
        universal = widen * MAD * math.sqrt(2 * math.log(max(int(k.sum()), 3)))
        inside = np.ones(len(k), dtype=bool)
        while True:
            axes = np.array([universal * middle(size[inside, j], k[inside]) for j in range(3)])
            with np.errstate(all="ignore"):
                far = np.where(size > 0, np.square(size / axes), 0.0).sum(axis=1)
            stay = inside & (far <= 1)
            if stay.sum() == inside.sum() or not stay.any():
                return tuple(axes)
            inside = stay

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finish(parts: list[pd.DataFrame]) -> pd.DataFrame:
            x = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            series, cells, k = x["series"].to_numpy(), x[["b0", "b1", "b2"]].to_numpy(np.int64), x["k"].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero(series[1:] != series[:-1]) + 1).tolist(), len(series)]
            out = [(series[a], *settle(cells[a:b], k[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pd.DataFrame(out, columns=["series", "a0", "a1", "a2"])

        for frame in frames:
            if not len(frame):
                continue
            last = frame["series"].to_numpy() == frame["series"].iloc[-1]
            if not last.all():
                yield finish([*held, frame[~last]])
                held = [frame[last]]
            else:
                # the same series as what is held, or the only one there is
                if held and held[0]["series"].iloc[-1] != frame["series"].iloc[-1]:
                    yield finish(held)
                    held = []
                held.append(frame)
        if held:
            yield finish(held)

    return run


def _flagging(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bars with the closes around them, their series' axes and the rule's limits, to the ids of those that can't be right."""
    for batch in frames:
        x = {name: column.to_numpy(zero_copy_only=False) for name, column in zip(batch.schema.names, batch.columns, strict=True) if name not in ("id", "hard")}
        close = {0: x["c"]} | {-k: x[f"m{k}"] for k in range(1, RUN + 1)} | {k: x[f"p{k}"] for k in range(1, RUN + 1)}
        limit, axes = x["limit"], [x["a0"], x["a1"], x["a2"]]
        with np.errstate(all="ignore"):
            first, own = x["o"] / close[-1] - 1, x["o"] / close[0] - 1
            flag = batch.column("hard").to_numpy(zero_copy_only=False).astype(bool) | (x["v"] > x["most"])
            flag |= ((first > limit) & (own > limit)) | ((first < -limit) & (own < -limit))
            whole = np.stack(list(close.values()))
            known = ~np.isnan(whole)
            total, count = np.where(known, whole, 0.0).sum(axis=0), known.sum(axis=0)
            for length in range(1, RUN + 1):
                for start in range(1 - length, 1):
                    run = np.stack([close[i] for i in range(start, start + length)])
                    before, after = close[start - 1], close[start + length]
                    middle = np.median(run, axis=0)
                    ahead, back = middle / before - 1, middle / after - 1
                    value = middle / ((total - run.sum(axis=0)) / (count - length)) - 1
                    far = sum(np.where(np.isnan(d) | (d == 0), 0.0, np.where(a > 0, np.square(d / a), np.inf)) for d, a in zip((value, ahead, ahead + back), axes, strict=True))
                    at = np.flatnonzero((far > 1) & ~flag)  # the candidates; the rule is asked of these alone
                    if len(at):
                        departs = np.concatenate([run[:, at] / before[at] - 1, run[:, at] / after[at] - 1])
                        flag[at[(departs > limit[at]).all(axis=0) | (departs < -limit[at]).all(axis=0)]] = True
        yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(flag))], names=["id"])


def implausible(
    bars: DataFrame, series: str = "ticker", at: str = "timestamp", bar_id: str = "bar_id", prices: tuple[str, str, str, str] = ("open", "high", "low", "close"), volume: str = "volume",
    partitions: int | None = None, widen: float = 1.0,
) -> DataFrame:
    """(bar_id) of the bars that can't be right, each once.

    Flagged: a price not above 0, a negative volume, high below low, open or close outside low to high; a run of one to three closes that depart, in one
    direction, from the closes before and after it by more than USUAL_MOVES usual moves; an open that departs so from the close before and its own; a volume
    over VOLUME_TIMES the median; STUCK or more bars on end with the same open, close and volume, not 0. The usual move is the series' median of
    |close / previous close - 1|.

    Runs come through the ellipsoids (see module). ``widen`` multiplies their axes: 1 loses no case, more may.

    Null and NaN fields are never at fault and null closes are passed over. Repeated deliveries (same series, time and id) count once; different bars at one
    time follow each other by id. A series without two closes has no usual move and only faults of bounds; an empty table gives no rows.
    """
    placed = placed_bars(bars, series, at, bar_id, prices, volume, partitions)
    move = F.abs(F.when(F.col("m1") != 0, F.col("c") / F.nullif(F.col("m1"), F.lit(0.0)) - 1).otherwise(F.when(F.col("c") != 0, float("inf"))))
    usual = exact_quantiles(placed, ["series"], {"move": move, "volume": F.col("v")}).withColumnRenamed("series", "_s1")
    cells = placed.where("c is not null and m1 is not null and p1 is not null").groupBy("series", "b0", "b1", "b2").agg(F.count("*").alias("k"))
    cores = bars.sparkSession.sparkContext.defaultParallelism
    axes = cells.repartition(cores, "series").sortWithinPartitions("series").mapInPandas(_ellipsoids(widen), "series string, a0 double, a1 double, a2 double").withColumnRenamed("series", "_s2")
    limit = USUAL_MOVES * F.col("move")
    # the first axis stays within the rule's departure, so that whatever departs so far lies outside
    scale = usual.join(axes, F.col("_s1") == F.col("_s2"), "left").select(
        F.col("_s1").alias("_series"), limit.alias("limit"), (VOLUME_TIMES * F.col("volume")).alias("most"), F.coalesce("a0", F.lit(float("inf"))).alias("a0"),
        F.least("a1", limit * widen).alias("a1"), F.coalesce("a2", F.lit(float("inf"))).alias("a2"),
    )
    x = placed.join(scale, F.col("series") == F.col("_series"), "left").select("id", "o", "c", "v", *_CLOSES, "hard", "limit", "most", "a0", "a1", "a2")
    return x.mapInArrow(_flagging, f"id {dict(bars.dtypes)[bar_id]}").distinct().withColumnRenamed("id", bar_id)

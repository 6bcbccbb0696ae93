"""Order-dependent operators: folds over a key's ordered rows, streamed through Arrow, and greedy packing.

Rows of a key are sorted in their partition and streamed; a fold holds its state and one batch, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Makes (a fresh state's step): a function from a row, a named tuple, to a row of the output.
Step = Callable[[tuple], tuple]


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Step], schema: str) -> DataFrame:
    """One output row for each row of df, made by a step that sees its key's rows in order; start() is called for each key.

    Null keys form a key of their own. Rows that order leaves equal come in any order, so it should be total. An empty table gives an empty result.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = object(), None
        for frame in frames:
            out = []
            places = [frame.columns.get_loc(k) for k in keys]
            for row in frame.itertuples(index=False):
                key = tuple(None if pd.isna(row[p]) else row[p] for p in places)
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def brake(cost_bps: float = 10.0) -> Callable[[], Step]:
    """Exposure cut to 2/3 below a drawdown of 10 % and to 1/2 below 20 %, of the braked equity itself; changes cost cost_bps. Rows: (key, day, r)."""

    def start() -> Step:
        equity = peak = before = 1.0

        def step(row: tuple) -> tuple:
            nonlocal equity, peak, before
            fall = 1 - equity / peak
            m = 0.5 if fall >= 0.20 else 2 / 3 if fall >= 0.10 else 1.0
            y = m * row.r - abs(m - before) * cost_bps / 1e4
            equity *= 1 + y
            peak, before = max(peak, equity), m
            return row.key, row.day, y, m, equity

        return step

    return start


def sticky_exposure(target: float = 0.15, cap: float = 1.5, band: float = 0.10, cost_bps: float = 5.0) -> Callable[[], Step]:
    """Exposure target / vol, at most cap, kept while it would move by band or less; changes cost. Rows: (key, day, r, vol), vol null if unknown."""

    def start() -> Step:
        before = 1.0

        def step(row: tuple) -> tuple:
            nonlocal before
            e = before if pd.isna(row.vol) or row.vol <= 0 else min(cap, target / row.vol)
            if abs(e - before) <= band:
                e = before
            y = e * row.r - abs(e - before) * cost_bps / 1e4
            before = e
            return row.key, row.day, y, e

        return step

    return start


def betting(cap: float = 0.5) -> Callable[[], Step]:
    """Wealth of a bettor on the mean of values in -1..1 being above 0, whose stake comes from the values before. Rows: (key, day, x)."""

    def start() -> Step:
        n = total = squares = 0.0
        wealth = best = 1.0

        def step(row: tuple) -> tuple:
            nonlocal n, total, squares, wealth, best
            stake = 0.0
            if n >= 2:
                mean = total / n
                second = squares / n
                stake = min(max(mean / second, 0.0), cap) if second > 0 else 0.0
            wealth *= 1 + stake * row.x
            best = max(best, wealth)
            n, total, squares = n + 1, total + row.x, squares + row.x * row.x
            return row.key, row.day, stake, wealth, best

        return step

    return start


def greedy(budget: int) -> Callable[[], Step]:
    """Takes each row whose size still fits the budget and skips the others, going on. Rows: (key, item, size)."""

    def start() -> Step:
        used = 0

        def step(row: tuple) -> tuple:
            nonlocal used
            takes = used + row.size <= budget
            used += row.size if takes else 0
            return row.key, row.item, bool(takes), used

        return step

    return start

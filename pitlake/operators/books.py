"""Paper books: whole shares of a few names, traded from session to session, as a fold over one row for each session.

A session's row has the names to hold, in order, with their prices, and what was held before with the prices at which it can be sold; so a fold's state is cash
and as many numbers as names are held, whatever the market's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.operators.folds import Step, fold


def sessions_of(targets: DataFrame, bars: DataFrame, book: str, day: str, name: str, place: str) -> DataFrame:
    """One row for each book and session: (key, day, new, old).

    targets: book, day, name, place - what each book wants to hold from the open of that day's session, the first place first; bars: day, name, open, close.
    new holds (open, close, before) of each wanted name, before being its index in old, if it is there; old holds (price, stays) of each name wanted in the
    session before. A name without a bar can't be bought and has a null open; it is sold at its last close.
    """
    t = targets.select(F.col(book).alias("key"), F.col(day).alias("day"), F.col(name).alias("name"), F.col(place).alias("place"))
    b = bars.select(F.col(day).alias("day"), F.col(name).alias("name"), "open", "close")
    held = t.join(b, ["day", "name"], "left")
    nxt = t.select("key", "day").distinct().withColumn("next", F.lead("day").over(W.partitionBy("key").orderBy("day")))
    before = held.join(nxt, ["key", "day"]).where("next is not null").select("key", F.col("next").alias("day"), "name", F.col("place").alias("was"), F.col("close").alias("last"))
    before = before.join(b.select("day", "name", F.col("open").alias("now")), ["day", "name"], "left").select("key", "day", "name", "was", F.coalesce("now", "last", F.lit(0.0)).alias("price"))
    both = held.join(before, ["key", "day", "name"], "full")
    new = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "open", "close", "was"))))
    old = F.sort_array(F.collect_list(F.when(F.col("was").isNotNull(), F.struct("was", "price", F.col("place").isNotNull().alias("stays")))))
    x = both.groupBy("key", "day").agg(new.alias("new"), old.alias("old"))  # a session's few names
    order = F.transform("old", lambda o: o["was"])
    index = lambda w: F.when(w.isNotNull(), F.array_position(order, w) - 1)
    return x.select(
        "key", "day", F.transform("new", lambda n: n["open"]).alias("opens"), F.transform("new", lambda n: n["close"]).alias("closes"), F.transform("new", lambda n: index(n["was"])).alias("before"),
        F.transform("old", lambda o: o["price"]).alias("prices"), F.transform("old", lambda o: o["stays"]).alias("stays"),
    )


def paper(cash: float, slip: float, halt: float, places: int) -> Callable[[], Step]:
    """Sells what leaves first, then brings every wanted name to an equal part of what is there, in whole shares; each trade costs slip of its value.

    A book that closes below its peak by halt or more is sold at the next session and stays in cash. Rows as of sessions_of; out: key, day, equity, cash,
    shares, traded, halted."""

    def start() -> Step:
        money, peak, halted, shares = cash, cash, False, []

        def step(row: tuple) -> tuple:
            nonlocal money, peak, halted, shares
            none = lambda v: v is None or v != v
            held = shares or [0] * len(row.prices)
            leaving = sum(h * p for h, p, s in zip(held, row.prices, row.stays, strict=True) if not s)
            there = money + sum(h * p for h, p in zip(held, row.prices, strict=True)) - slip * leaving
            bought, traded, left = [], leaving, there
            for o, b in zip(row.opens, row.before, strict=True):
                had = 0 if none(b) else held[int(b)]
                price = row.prices[int(b)] if none(o) and not none(b) else o
                n = 0 if halted or none(o) or o <= 0 else math.floor(there / places / (o * (1 + slip)))
                change = 0.0 if none(price) else abs(n - had) * price
                left -= (0.0 if none(o) else n * o) + slip * change
                traded += change
                bought.append(n)
            equity = left + sum(n * c for n, c in zip(bought, row.closes, strict=True) if n)
            money, shares, peak = left, bought, max(peak, equity)
            halted = halted or equity <= peak * (1 - halt)
            return row.key, row.day, equity, money, int(sum(bought)), traded, halted

        return step

    return start


def paper_books(sessions: DataFrame, key: str, cash: float = 100_000.0, slip: float = 0.0005, halt: float = 0.3, places: int = 5) -> DataFrame:
    """(key, day, equity, cash, shares, traded, halted) of each book's sessions; key: its type. Books are independent and fold in parallel."""
    return fold(sessions, ["key"], ["day"], paper(cash, slip, halt, places), f"key {key}, day date, equity double, cash double, shares bigint, traded double, halted boolean")

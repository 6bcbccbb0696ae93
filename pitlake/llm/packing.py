"""Items laid into containers of fixed capacity, by harmonic packing.

Sizes are partitioned into reciprocal-capacity classes: class k holds those of at most 1/k of the capacity, and more than 1/(k+1), of which k always fit in
one container. Each worker fills each class's containers with that fixed count, independently of the others, for its share of the items: how many shares
there are follows from the number of items, so that the result is the same on every cluster. Within a share, items below the last class first fill what
the larger ones leave over, then containers of their own. An item above the capacity is cut into full containers and a rest, which is packed as an item.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.session import materialised

#: Classes of fixed counts; items of at most capacity / (CLASSES + 1) fill gaps.
CLASSES = 24
#: Items of a partition, as hashed by item: more would hardly lift the fill. And items that a worker packs at once, which bounds its memory.
SHARE, CHUNK = 20_000, 200_000


def harmonic(sizes: list[int], capacity: int, classes: int = CLASSES) -> tuple[list[int], int]:
    """The container of each size (all at most capacity, none negative) and the number of containers."""
    bins, room = [0] * len(sizes), []
    groups: list[list[int]] = [[] for _ in range(classes + 1)]
    for i, s in enumerate(sizes):
        groups[min(capacity // s, classes + 1) - 1 if s else classes].append(i)
    # large classes first: class k fills what classes below it have left before it opens containers of its own
    gaps: list[tuple[int, int]] = []  # (room, container), rising

    def gap(size: int) -> int | None:
        """Takes size from the smallest gap that holds it."""
        k = bisect_right(gaps, (size, -1))
        if k == len(gaps):
            return None
        left, b = gaps.pop(k)
        if left - size > 0:
            at = bisect_right(gaps, (left - size, b))
            gaps.insert(at, (left - size, b))
        return b

    for k, members in enumerate(groups[:-1], start=1):
        members.sort(key=lambda i: -sizes[i])
        rest = []
        for i in members:
            b = gap(sizes[i]) if k > 1 else None
            if b is None:
                rest.append(i)
            else:
                bins[i] = b
        for start in range(0, len(rest), k):  # the fixed count of this class
            own = rest[start : start + k]
            for i in own:
                bins[i] = len(room)
            room.append(capacity - sum(sizes[i] for i in own))
            if room[-1]:
                gaps.insert(bisect_right(gaps, (room[-1], len(room) - 1)), (room[-1], len(room) - 1))
    small = sorted(groups[-1], key=lambda i: -sizes[i])
    for i in small:
        b = gap(sizes[i])
        if b is None:
            b = len(room)
            room.append(capacity)
            if capacity - sizes[i] > 0:
                gaps.insert(bisect_right(gaps, (capacity - sizes[i], b)), (capacity - sizes[i], b))
        bins[i] = b
    return bins, len(room)


def packed(df: DataFrame, item: str, size: str, capacity: int, classes: int = CLASSES, partitions: int | None = None) -> DataFrame:
    """(container, item, part, start, length): every item once, or its consecutive parts if it is larger than capacity; no container holds more than capacity.

    container is unique over all workers and the same whenever the same items are packed, whatever the cluster, unless a number of partitions is given. A null size counts as 0; items
    of size 0 are laid into a container too. A negative size is an error. Repeated items are laid as often as they come. An empty table gives no rows.
    """
    kind = dict(df.dtypes)[item]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held, count = TaskContext.get().partitionId() << 40, [], 0

        def settle(x: pd.DataFrame) -> pd.DataFrame:
            nonlocal base
            ids, parts, starts, lengths = [], [], [], []
            for i, s in zip(x["item"].tolist(), x["size"].tolist(), strict=True):
                if s < 0:
                    raise ValueError(f"item {i} has the negative size {s}")
                for part, start in enumerate(range(0, max(s, 1), capacity)):
                    ids.append(i)
                    parts.append(part)
                    starts.append(start)
                    lengths.append(min(capacity, s - start))
            bins, n = harmonic(lengths, capacity, classes)
            out = pd.DataFrame({"container": [base + b for b in bins], "item": ids, "part": parts, "start": starts, "length": lengths})
            base += n
            return out

        for x in frames:
            held.append(x)
            count += len(x)
            if count >= CHUNK:
                yield settle(pd.concat(held, ignore_index=True))
                held, count = [], 0
        if count:
            yield settle(pd.concat(held, ignore_index=True))

    x = df.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    if partitions is None:  # counted from a table of numbers, so that sizes aren't worked out twice
        x = materialised(x, "sizes")
        partitions = max(1, math.ceil(x.count() / SHARE))
    out = x.repartition(partitions, F.xxhash64("item")).sortWithinPartitions("item", "size").mapInPandas(run, f"container bigint, item {kind}, part int, start bigint, length bigint")
    return out.withColumnRenamed("item", item)


def containers_needed(total: int, capacity: int) -> int:
    """What no packing can stay below."""
    return math.ceil(total / capacity)

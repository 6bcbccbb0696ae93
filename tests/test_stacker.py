import datetime as dt
import math
import random

import pytest

from pitlake.plans.valuation import guarded


def rows_of(seed, n, turns):
    """Forecasts that are upside down; if it turns, right from day 20 on, so that what was learned before does harm."""
    r, out = random.Random(seed), []
    for i in range(n):
        p, x, day = r.uniform(0.05, 0.95), r.gauss(0, 1), r.randrange(30)
        out.append((f"r{i:05}", dt.date(2020, 1, 1) + dt.timedelta(days=day), p, x, r.random() < (p if turns and day >= 20 else 1 - p)))
    return out


def plain_losses(rows):
    """Both log losses on the newer 30 %, by plain gradient descent on the older 70 %."""
    rows = sorted(rows, key=lambda x: (x[1], x[0]))
    cut = int(len(rows) * 0.7)
    xs = [(math.log(p / (1 - p)), x, 1.0) for _, _, p, x, _ in rows]
    ys, w = [float(x[4]) for x in rows], [0.0] * 3
    chance = lambda x: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
    for _ in range(1500):
        err = [chance(x) - y for x, y in zip(xs[:cut], ys[:cut], strict=True)]
        w = [w[j] - 0.5 * (sum(e * x[j] for e, x in zip(err, xs, strict=False)) / cut + (0.05 * w[j] if j < 2 else 0)) for j in range(3)]
    loss = lambda ps: -sum(math.log(p if y else 1 - p) for p, y in zip(ps, ys[cut:], strict=True)) / len(ps)
    return loss([chance(x) for x in xs[cut:]]), loss([x[2] for x in rows[cut:]])


@pytest.mark.parametrize("turns", [True, False])
def test_stacker_is_adopted_only_if_better(spark, turns):
    rows = rows_of(4, 333, turns)
    df = spark.createDataFrame(rows, "id string, day date, p double, x double, up boolean")
    w, n, stacked, alone = guarded(df, "day", "id", "p", ["x"], "up")
    want = plain_losses(rows)
    assert n == 333 and (stacked, alone) == pytest.approx(want, abs=1e-5)
    assert (w is not None) == (want[0] < want[1]) == (not turns)
    assert guarded(df.limit(199), "day", "id", "p", ["x"], "up") == (None, 199, None, None)


def test_stacker_without_rows(spark):
    df = spark.createDataFrame([], "id string, day date, p double, x double, up boolean")
    assert guarded(df, "day", "id", "p", ["x"], "up") == (None, 0, None, None)

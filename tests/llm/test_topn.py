import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pitlake.llm import topn
from pitlake.llm.topn import top_n

S = "g string, h string, s double, at bigint, id bigint, place string"


def brute(rows, n):
    out, groups = set(), {}
    for g, h, s, at, i, _ in rows:
        if None in (g, h, i) or s is None or s != s or abs(s) == float("inf"):
            continue
        items = groups.setdefault((g, h), {})
        items[i] = min(items.get(i, (9e9,)), (-s, at is None, at or 0, i))
    for (g, h), items in groups.items():
        for k, i in enumerate(sorted(items, key=items.get)[:n], 1):
            out.add((g, h, k, i))
    return out


def run(spark, rows, n=3):
    got = top_n(spark.createDataFrame(rows, S), ["g", "h"], "s", ["at"], "id", n).collect()
    assert len(got) == len({(r.g, r.h, r.place) for r in got})
    return {(r.g, r.h, r.place, r.id) for r in got}


@pytest.mark.parametrize("bytes_", [1, 1 << 20])
@pytest.mark.parametrize("files", ["1", "7"])
def test_against_brute_force(spark, monkeypatch, bytes_, files):
    monkeypatch.setattr(topn, "ROW_GROUP_BYTES", bytes_)
    r = random.Random(1)
    rows = []
    for i in range(4000):
        g = r.choice(["hot", "hot", "a", "b", f"c{r.randrange(200)}"])  # one group holds a third and more
        rows.append((g, r.choice(["x", "y"]) if g != "hot" else "x", r.choice([r.random(), 0.5, -0.0, 0.0, 7.0, None, float("nan"), float("inf")]), r.choice([r.randrange(5), None]), i, "p"))
    rows += rows[::9] + [(None, "x", 1.0, 1, 9001, ""), ("a", None, 1.0, 1, 9002, ""), ("a", "x", 9.0, 1, None, "")]
    with _files(spark, files):
        assert run(spark, rows) == brute(rows, 3)


class _files:
    """So many files for the clustered rows, however few bytes they are."""

    def __init__(self, spark, n):
        self.conf, self.new = spark.conf, {"spark.sql.shuffle.partitions": n, "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def __enter__(self):
        self.old = {k: self.conf.get(k) for k in self.new}
        for k, v in self.new.items():
            self.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.conf.set(k, v)


@pytest.mark.parametrize("bytes_", [1, 1 << 20])
def test_items_repeated_in_several_files(spark, monkeypatch, bytes_):
    """One item with 250 scores ahead of all others, over many files and row groups, takes one place."""
    monkeypatch.setattr(topn, "ROW_GROUP_BYTES", bytes_)
    rows = [("a", "x", float(i), None, i, "") for i in range(2000)] + [("a", "x", 5000.0 + k, None, 7, "") for k in range(250)]
    with _files(spark, "20"):
        assert run(spark, rows) == {("a", "x", 1, 7), ("a", "x", 2, 1999), ("a", "x", 3, 1998)} == brute(rows, 3)


def test_all_equal_and_big_ids(spark):
    rows = [("a", "x", 1.0, None, 2**62 + i, "") for i in range(50)]
    assert run(spark, rows, 2) == {("a", "x", 1, 2**62), ("a", "x", 2, 2**62 + 1)}


def test_groups_whose_texts_run_together(spark):
    rows = [("a", "bc", 1.0, None, 1, ""), ("ab", "c", 2.0, None, 2, ""), ("", "abc", 3.0, None, 3, "")]
    assert run(spark, rows, 1) == brute(rows, 1)


def test_empty(spark):
    assert run(spark, []) == set() and run(spark, [("a", "x", None, 1, 1, "")]) == set()


def test_row_groups_below_are_skipped(spark, monkeypatch):
    """Of the largest group of a table, whole as it is, hardly more than one row group is read, in whatever file the others are."""
    folder = Path("/root/testdata/sf0.1/ledger.parquet")
    if not folder.exists():
        pytest.skip("no test tables here")
    monkeypatch.setattr(topn, "ROW_GROUP_BYTES", 1)  # the smallest that the writer makes: 100 rows
    x = spark.read.parquet(str(folder)).where("type = 'decision' and logodds is not null and not isnan(logodds) and abs(logodds) < double('inf')")
    x = x.select(F.col("type").alias("g"), F.col("logodds").alias("score"), F.unix_micros("written_at").alias("tie0"), F.col("seq").alias("item"))
    order = [F.desc("score"), F.asc_nulls_last("tie0"), F.asc("item")]
    with _files(spark, "8"):
        kept, groups, second = topn.rounds(x, order, ["tie0"], 3)
        got = [r.item for r in topn._placed(kept, order, 3).orderBy("place").collect()]
        all_, read = groups.count(), second.count() + groups.where("turn = 1").count()
    assert all_ > 100 and read <= 3
    assert got == [r.item for r in x.distinct().orderBy(*order).limit(3).collect()]


def test_reader_skips_as_the_nth_score_rises(tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 10_000
    frame = pd.DataFrame({"g": ["a"] * n, "score": [float(n - i) for i in range(n)], "tie0": range(n), "item": range(n)})
    path = str(tmp_path / "f.parquet")
    pq.write_table(pa.Table.from_pandas(frame), path, row_group_size=500)
    groups = pd.concat(topn._footers(iter([pd.DataFrame({"file": [f"file://{path}"]})])))
    assert groups["best"].tolist() == [float(n - 500 * k) for k in range(20)] and set(groups["only"]) == {"a"}
    out = list(topn._reader(["g", "score", "tie0", "item"], ["tie0"], 3)(iter([groups.assign(nth=None)])))
    assert len(out) == 1 and out[0]["item"].tolist() == [0, 1, 2]

import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitlake.functions import columns as c


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_ranks_equal_pandas(spark):
    r = random.Random(1)
    rows = [(g, r.choice([None, float(r.randrange(6))])) for g in "ab" for _ in range(60)] + [("one", 1.0), ("none", None)]
    p = pd.DataFrame(rows, columns=["g", "x"]).reset_index()
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, g string, x double")
    got = df.select("i", c.average_rank("x", "g").alias("a"), c.percent_of("x", "g").alias("p"), c.unit_rank("x", "g").alias("u")).toPandas().sort_values("i")
    a = p.groupby("g")["x"].rank()
    n = p.groupby("g")["x"].transform("count")
    assert np.allclose(got["a"], a, equal_nan=True) and np.allclose(got["p"], p.groupby("g")["x"].rank(pct=True), equal_nan=True)
    assert np.allclose(got["u"], (a - 1) / np.maximum(n - 1, 1), equal_nan=True)


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 9.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(c.correlation("x", "y").alias("r")).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0) and got["c"] is None


def test_normal(spark):
    z = [-6.0, -2.5, -0.1, 0.0, 0.3, 1.96, 5.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(c.normal_cdf(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([NormalDist().cdf(x) for x in z], abs=2e-7)
    q = [1e-6, 0.02, 0.3, 0.5, 0.95, 0.999]
    got = spark.createDataFrame([(x,) for x in q], "p double").select(c.normal_ppf(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(x) for x in q], abs=1e-7)
    assert one(spark, c.normal_ppf(F.lit(1.0))) is None


@pytest.mark.parametrize("value,quote,scaled,want", [
    (1234.5, "was $1,234.5 last year", False, True), (-12.0, "a loss of (12) cents", False, True), (5.0, "nothing here", False, False), (1500.0, "$1.5 billion", True, True), (1500.0, "$1.5 billion", False, False), (2.0, None, False, None),
])
def test_states(spark, value, quote, scaled, want):
    df = spark.createDataFrame([(value, quote)], "v double, q string")
    assert df.select(c.states(F.col("v"), F.col("q"), scaled).alias("x")).first().x == want


def test_texts_and_dates(spark):
    assert one(spark, c.visible_text(F.lit("<p>A&amp;B</p><script>x<1</script><!-- c --> &lt;b&gt;\n c"))) == "A&B <b> c"
    assert one(spark, c.plain_text(F.lit("  It’s — “OK”\n now "))) == "it's - \"ok\" now"
    assert one(spark, c.clip(F.lit(None).cast("double"), 0, 1)) is None and one(spark, c.div(F.lit(1.0), 0.0)) is None
    day = F.lit("2024-11-20").cast("date")
    assert [str(one(spark, f(day))) for f in (c.third_friday, c.last_friday, c.week_end)] == ["2024-11-15", "2024-11-29", "2024-11-22"]

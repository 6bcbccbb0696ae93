"""Valuation, risk and statement formulas as column expressions, and regressions by normal equations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import back, div, normal_cdf, normal_ppf
from pitlake.plans.registry import query
from pitlake.plans.scores import _cdf_sql
from pitlake.plans.views import preds, px_d, using
from pitlake.plans.windows import by_day
from pitlake.session import materialised
from pitlake.sources.tables import table


def present_value(cash: Column, growth: Column, rate: Column, terminal: Column, years: int) -> Column:
    """Of cash flows that grow for some years and then for ever at terminal; null where rate is not above terminal."""
    flows = sum((cash * F.pow(1 + growth, F.lit(k)) / F.pow(1 + rate, F.lit(k)) for k in range(1, years + 1)), F.lit(0.0))
    last = cash * F.pow(1 + growth, F.lit(years)) * (1 + terminal)
    return F.when(rate > terminal, flows + last / (rate - terminal) / F.pow(1 + rate, F.lit(years)))


@query(
    """with g as (select p_partkey, cast(p_size as double) as cash, gr, r from part, (select unnest([0.02, 0.05]) as gr), (select unnest([0.08, 0.10]) as r)) select p_partkey, cast(gr as double) as growth, cast(r as double) as rate,
round(list_sum([cash * pow(1 + gr, k) / pow(1 + r, k) for k in range(1, 6)]) + cash * pow(1 + gr, 5) * 1.01 / (r - 0.01) / pow(1 + r, 5), 4) as value from g"""
)
def dcf_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Present values over a grid of growth and discount rates; the grid is a literal array."""
    p = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("cash"))
    p = p.withColumn("growth", F.explode(F.array(F.lit(0.02), F.lit(0.05)))).withColumn("rate", F.explode(F.array(F.lit(0.08), F.lit(0.10))))
    return p.select("p_partkey", "growth", "rate", F.round(present_value(F.col("cash"), F.col("growth"), F.col("rate"), F.lit(0.01), 5), 4).alias("value"))


@query(
    "with o as (select c_custkey, 100.0::double as s, 80.0 + c_custkey % 41 as k, 0.1 + (c_custkey % 7) * 0.05 as v, 0.5 as t from customer), d as (select *, (ln(s / k) + (0.03 + v * v / 2) * t) / (v * sqrt(t)) as d1 from o), e as (select *, d1 - v * sqrt(t) as d2 from d) select c_custkey, round(s * "
    + _cdf_sql("d1") .replace("case", "(case", 1) + ") - k * exp(-0.03 * t) * (" + _cdf_sql("d2") + "), 4) as call, round(" + _cdf_sql("d1") + f", 5) as delta, round(exp(-d1 * d1 / 2) / {math.sqrt(2 * math.pi)!r} / (s * v * sqrt(t)), 6) as gamma, round(s * exp(-d1 * d1 / 2) / {math.sqrt(2 * math.pi)!r} * sqrt(t) / 100, 6) as vega from e"
)
def option_greeks(spark: SparkSession, folder: str) -> DataFrame:
    """Price and sensitivities of calls in closed form."""
    c = table(spark, folder, "customer").select("c_custkey")
    s, t, r = F.lit(100.0), F.lit(0.5), 0.03
    x = c.withColumn("k", 80.0 + F.pmod("c_custkey", F.lit(41))).withColumn("v", 0.1 + F.pmod("c_custkey", F.lit(7)) * 0.05)
    k, v = F.col("k"), F.col("v")
    x = x.withColumn("d1", (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))).withColumn("d2", F.col("d1") - v * F.sqrt(t))
    density = F.exp(-F.col("d1") * F.col("d1") / 2) / math.sqrt(2 * math.pi)
    return x.select(
        "c_custkey", F.round(s * normal_cdf(F.col("d1")) - k * F.exp(-r * t) * normal_cdf(F.col("d2")), 4).alias("call"), F.round(normal_cdf(F.col("d1")), 5).alias("delta"), F.round(density / (s * v * F.sqrt(t)), 6).alias("gamma"),
        F.round(s * density * F.sqrt(t) / 100, 6).alias("vega"),
    )


@query(
    using("px_d")
    + ", r as (select close / lag(close) over (order by day) - 1 as r from px_d), a as (select avg(r) as m, stddev_samp(r) as s, quantile_cont(r, 0.05) as q from r) select round(-q, 6) as hist_var, round((select -avg(r) from r where r <= q), 6) as cvar, round(1.6448536269514722 * s - m, 6) as param_var, round(m / (s * s), 4) as kelly from a"
)
def value_at_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Historical and parametric value at risk, shortfall and the growth-optimal fraction."""
    r = px_d(spark, folder).select(back("close", 1, by_day()).alias("r"))
    low = r.agg(F.percentile("r", 0.05)).first()[0]  # one number
    q = F.lit(float(low if low is not None else 0.0))
    a = r.agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), (-F.avg(F.when(F.col("r") <= q, F.col("r")))).alias("cvar"))
    return a.select(F.round(-q, 6).alias("hist_var"), F.round("cvar", 6).alias("cvar"), F.round(normal_ppf(F.lit(0.95)) * F.col("s") - F.col("m"), 6).alias("param_var"), F.round(div(F.col("m"), F.col("s") * F.col("s")), 4).alias("kelly"))


@query(
    using("preds")
    + """, g as (select arm, count(*) as n, avg(ret) as m, regr_slope(ret, p) as b, regr_intercept(ret, p) as a, regr_r2(ret, p) as r2 from preds group by arm) select arm, n, round(a, 5) + 0.0 as intercept, round(b, 5) + 0.0 as slope, round(r2, 6) as r2 from g"""
)
def one_factor(spark: SparkSession, folder: str) -> DataFrame:
    """A regression of outcome on forecast by arm."""
    g = preds(spark, folder).groupBy("arm").agg(F.count("*").alias("n"), F.regr_intercept("ret", "p").alias("a"), F.regr_slope("ret", "p").alias("b"), F.regr_r2("ret", "p").alias("r2"))
    return g.select("arm", "n", (F.round("a", 5) + 0.0).alias("intercept"), (F.round("b", 5) + 0.0).alias("slope"), F.round("r2", 6).alias("r2"))


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> tuple[list[float], float]:
    """Weights of standardised features and the free intercept, by sums that one pass over df makes; only features x features numbers reach the driver.

    Rows with a null feature or target don't count; a constant feature has weight 0.
    """
    import numpy as np

    x = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y")).dropna()
    k = len(features)
    names = [f"x{i}" for i in range(k)] + ["y"]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"c{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]]
    row = x.agg(*sums).first()
    n = row["n"]
    if not n:
        return [0.0] * k, 0.0
    mean = np.array([row[c] for c in names]) / n
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] / n - mean[i] * mean[j] for j in range(k + 1)] for i in range(k + 1)])
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    live = sd > 1e-12
    z = cov[:k, :k] / np.outer(np.where(live, sd, 1), np.where(live, sd, 1))
    w = np.zeros(k)
    w[live] = np.linalg.solve(z[np.ix_(live, live)] + penalty / n * np.eye(int(live.sum())), (cov[:k, k] / np.where(live, sd, 1))[live])
    return w.tolist(), float(mean[k])


def logistic(df: DataFrame, features: list[str], target: str, penalty: float = 1.0, passes: int = 25, tolerance: float = 1e-9) -> list[float]:
    """Weights (the free intercept last) by Newton's method: each pass sums gradient and curvature over df, which only features x features numbers leave.

    Rows with a null feature or target don't count.
    """
    import numpy as np

    k = len(features)
    x = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y")).dropna().withColumn(f"x{k}", F.lit(1.0))
    w = np.zeros(k + 1)
    for _ in range(passes):
        z = sum((F.col(f"x{i}") * float(w[i]) for i in range(k + 1)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        y = x.withColumn("p", p).withColumn("h", F.col("p") * (1 - F.col("p")))
        row = y.agg(*[F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(k + 1)], *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
        if row["g0"] is None:
            return w.tolist()
        ridge_ = np.diag([penalty] * k + [0.0])
        g = np.array([row[f"g{i}"] for i in range(k + 1)]) + ridge_ @ w
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + ridge_
        step = np.linalg.solve(h + 1e-12 * np.eye(k + 1), g)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    return w.tolist()


def _newton_sql(passes: int) -> str:
    """Newton's method for two features x1, x2 and a free intercept over the rows of ``old``, a step for each pass, solved by Cramer's rule."""
    z = "1 / (1 + exp(-(a * x1 + b * x2 + c)))"
    sums = {"g1": "(q - y) * x1", "g2": "(q - y) * x2", "g3": "q - y", "h11": "q * (1 - q) * x1 * x1", "h12": "q * (1 - q) * x1 * x2", "h13": "q * (1 - q) * x1", "h22": "q * (1 - q) * x2 * x2", "h23": "q * (1 - q) * x2", "h33": "q * (1 - q)"}
    det = lambda r1, r2, r3: f"({r1[0]} * ({r2[1]} * {r3[2]} - {r2[2]} * {r3[1]}) - {r1[1]} * ({r2[0]} * {r3[2]} - {r2[2]} * {r3[0]}) + {r1[2]} * ({r2[0]} * {r3[1]} - {r2[1]} * {r3[0]}))"
    rows = [["h11", "h12", "h13"], ["h12", "h22", "h23"], ["h13", "h23", "h33"]]
    step = [f"{det(*[[f'g{i + 1}' if j == k else rows[i][j] for j in range(3)] for i in range(3)])} / {det(*rows)}" for k in range(3)]
    out = ["w0 as (select 0.0::double as a, 0.0::double as b, 0.0::double as c)"]
    for k in range(1, passes + 1):
        out.append(f"s{k} as materialized (select any_value(a) as a, any_value(b) as b, any_value(c) as c, " + ", ".join(f"sum({e})" + {"g1": " + any_value(a)", "g2": " + any_value(b)", "h11": " + 1", "h22": " + 1"}.get(n, "") + f" as {n}" for n, e in sums.items()) + f" from (select *, {z} as q from old, w{k - 1}))")
        out.append(f"w{k} as materialized (select a - {step[0]} as a, b - {step[1]} as b, c - {step[2]} as c from s{k})")
    return ", ".join(out)


@query(
    using("preds")
    + ", x as (select made - date '1970-01-01' as d, p as x1, ln(cast(h as double)) as x2, case when up then 1.0::double else 0.0 end as y from preds), e as (select quantile_cont(d, 0.6666666666666666) as e from x), old as (select x.* from x, e where d <= e), "
    + _newton_sql(12)
    + " select count(*) as n, round(avg(pow(1 / (1 + exp(-(a * x1 + b * x2 + c))) - y, 2)), 6) as brier, round(avg(pow((select avg(y) from old) - y, 2)), 6) as base from x, e, w12 where d > e"
)
def fitted_direction(spark: SparkSession, folder: str) -> DataFrame:
    """A logistic model of the direction, fitted on the older two thirds by time, with its loss on the newer third against the base rate."""
    x = preds(spark, folder).withColumn("h2", F.log(F.col("h").cast("double"))).withColumn("y", F.col("up").cast("double"))
    edge = x.agg(F.percentile(F.unix_date("made"), 2 / 3).alias("e")).first()["e"]
    if edge is None:
        return spark.createDataFrame([], "n bigint, brier double, base double")
    old, new = x.where(F.unix_date("made") <= edge), x.where(F.unix_date("made") > edge)
    w = logistic(old, ["p", "h2"], "y")
    base = old.agg(F.avg("y")).first()[0]
    p = 1 / (1 + F.exp(-(F.col("p") * w[0] + F.col("h2") * w[1] + w[2])))
    return new.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(p - F.col("y"), 2)), 6).alias("brier"), F.round(F.avg(F.pow(F.lit(base) - F.col("y"), 2)), 6).alias("base"))


def guarded(df: DataFrame, at: str, row_id: str, chance: str, features: list[str], target: str, least: int = 200, l2: float = 0.05) -> tuple[list[float] | None, int, float | None, float | None]:
    """(weights, rows, log loss of the stacker, of chance alone): a logistic stacker of the logit of chance and features, adopted only if it is better.

    Fitted on the older 70 % of rows by at (a day) and row_id, which is unique, and judged on the newer 30 % by mean log loss. If it is better there it is fitted
    anew on all rows; else, and with fewer than ``least`` rows, it has no weights (None). l2 weighs half the squared weights against the mean loss; the
    intercept, last, is free. Chances are held 1e-6 away from 0 and 1. Rows with a null don't count.
    """
    f = [f"f{i}" for i in range(len(features) + 1)]
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(chance).cast("double")))
    x = df.select(F.col(at).alias("at"), F.col(row_id).alias("id"), q.alias("q"), F.log(q / (1 - q)).alias("f0"), *[F.col(c).cast("double").alias(k) for c, k in zip(features, f[1:], strict=True)], F.col(target).cast("double").alias("y")).dropna()
    x = materialised(x, "stacker")  # read once for each pass
    n = x.count()
    if n < least:
        return None, n, None, None
    cut = int(n * 0.7)
    days = x.groupBy("at").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("at")))  # one row a day
    day = days.where(F.col("upto") > cut).orderBy("at").first()
    part = cut - (day["upto"] - day["n"])
    edge = x.where(F.col("at") == F.lit(day["at"])).orderBy("id").limit(part).agg(F.max("id")).first()[0] if part else None
    older = F.col("at") < F.lit(day["at"])
    if edge is not None:
        older = older | ((F.col("at") == F.lit(day["at"])) & (F.col("id") <= F.lit(edge)))
    w = logistic(x.where(older), f, "y", l2 * cut)
    z = sum((F.col(k) * v for k, v in zip(f, w[:-1], strict=True)), F.lit(w[-1]))
    fitted = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    loss = lambda p: F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p)))
    stacked, alone = x.where(~older).agg(loss(fitted), loss(F.col("q"))).first()
    return (logistic(x, f, "y", l2 * n) if stacked < alone else None), n, stacked, alone


@query()
def guarded_stacker(spark: SparkSession, folder: str) -> DataFrame:
    """A stacker of the forecasts with the log of their horizon, adopted only if it beats the forecasts alone on the newest 30 %: one row, weights null unless adopted."""
    x = preds(spark, folder).withColumn("h2", F.log(F.col("h").cast("double")))
    w, n, stacked, alone = guarded(x, "made", "run_id", "p", ["h2"], "up")
    state = "not_enough_data" if stacked is None else "adopted" if w else "rejected"
    r = lambda v: None if v is None else round(v, 4)
    return spark.createDataFrame([(n, state, r(stacked), r(alone), w and [round(v, 6) for v in w])], "n bigint, stacker string, stacker_holdout_ll double, llm_holdout_ll double, weights array<double>")


def least_variance(cov: list[list[float]]) -> list[float]:
    """Weights of the portfolio of least variance that sum to 1, by the pseudo-inverse."""
    import numpy as np

    inverse = np.linalg.pinv(np.array(cov, dtype=float))
    raw = inverse @ np.ones(len(inverse))
    return (raw / raw.sum()).tolist() if abs(raw.sum()) > 1e-300 else [1 / len(raw)] * len(raw)


@query(
    """with recursive x as (select s_nationkey as sym, cast(date_trunc('month', l_shipdate) as date) as m, cast(sum(l_quantity) as double) as q from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
p as (select a.sym as a, b.sym as b, round(covar_samp(a.q, b.q), 3) as c from x a join x b on a.m = b.m group by 1, 2), r as (select a, list(c order by b) || [1.0::double] as row from p group by a), m0 as (select list(a order by a) as names, list(row order by a) as m, count(*) as n from r),
g as (select 1 as k, n, m from m0 union all select k + 1, n, [case when i = k then [v / m[k][k] for v in m[k]] else [m[i][j] - m[i][k] * m[k][j] / m[k][k] for j in range(1, n + 2)] end for i in range(1, n + 1)] from g where k <= n),
w as (select [row[n + 1] for row in m] as w from g where k = n + 1) select unnest(names) as nation, unnest([round(v / list_sum(w), 6) for v in w]) as weight from w, m0"""
)
def least_variance_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of least variance over the nations' monthly quantities: the covariances are aggregated in Spark, nations x nations numbers reach the driver."""
    from pitlake.plans.relational import correlation_matrix

    cells = correlation_matrix(spark, folder).select("a", "b", "c").collect()
    names = sorted({r.a for r in cells} | {r.b for r in cells})
    at = {n: i for i, n in enumerate(names)}
    cov = [[0.0] * len(names) for _ in names]
    for r in cells:
        cov[at[r.a]][at[r.b]] = cov[at[r.b]][at[r.a]] = float(r.c)
    rows = [(int(n), round(w, 6)) for n, w in zip(names, least_variance(cov), strict=True)] if names else []
    return spark.createDataFrame(rows, "nation bigint, weight double")


@query()
def policy_positions(spark: SparkSession, folder: str) -> DataFrame:
    """A policy fitted on the older two thirds by time, with its mean reward on all rows of the newer third against always holding."""
    from pitlake.operators.policy import fitted, positions

    x = preds(spark, folder).withColumn("h2", F.log(F.col("h").cast("double")))
    edge = x.agg(F.percentile(F.unix_date("made"), 2 / 3)).first()[0]
    net = None if edge is None else fitted(x.where(F.unix_date("made") <= edge), ["p", "h2"], "ret", "run_id")
    if net is None:
        return spark.createDataFrame([], "arm string, n bigint, reward double, holding double")
    y = positions(x.where(F.unix_date("made") > edge), net, ["p", "h2"])
    return y.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("position") * F.col("ret")), 6).alias("reward"), F.round(F.avg("ret"), 6).alias("holding"))

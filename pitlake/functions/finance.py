"""Figures of statements, capital costs, performance and risk as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlake.functions.columns import div

# Each ratio's numerator, as signed items, and its denominator.
RATIOS = {
    "gross_margin": ("revenue - cogs", "revenue"), "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue"),
    "current_ratio": ("current_assets", "current_liabilities"), "quick_ratio": ("current_assets - inventory", "current_liabilities"),
    "debt_to_equity": ("total_debt", "total_equity"), "interest_coverage": ("ebit", "interest_expense"), "return_on_equity": ("net_income", "average_equity"),
    "return_on_invested_capital": ("nopat", "invested_capital"), "free_cash_flow_yield": ("operating_cash_flow - capex", "market_cap"),
    "price_to_earnings": ("price", "eps"), "ev_to_ebitda": ("enterprise_value", "ebitda"), "peg_ratio": ("price / eps", "eps_growth_pct"),
}
# The weights of Altman's Z and what each is of.
ALTMAN = ((1.2, "working_capital", "total_assets"), (1.4, "retained_earnings", "total_assets"), (3.3, "ebit", "total_assets"), (0.6, "market_cap", "total_liabilities"), (1.0, "revenue", "total_assets"))


def ratio(name: str) -> Column:
    """A ratio of RATIOS from columns named as its items; null where a denominator is 0 or an item is missing."""
    top, bottom = RATIOS[name]
    if "/" in top:
        a, b = top.split(" / ")
        return div(div(F.col(a), F.col(b)), F.col(bottom))
    return div(F.expr(top), F.col(bottom))


def altman() -> Column:
    """Altman's Z of a public manufacturer; null where there are no assets or no liabilities."""
    return sum((w * div(F.col(a), F.col(b)) for w, a, b in ALTMAN), F.lit(0.0))


def piotroski(now: Mapping[str, Column], before: Mapping[str, Column]) -> Column:
    """How many of Piotroski's nine signals hold, given two years' items; a signal that can't be told doesn't."""
    of = lambda x, a, b: div(x[a], x[b])
    better = lambda a, b: of(now, a, b) > of(before, a, b)
    signals = [
        now["net_income"] > 0, now["operating_cash_flow"] > 0, better("net_income", "total_assets"), now["operating_cash_flow"] > now["net_income"],
        of(now, "total_debt", "total_assets") < of(before, "total_debt", "total_assets"), better("current_assets", "current_liabilities"), now["shares"] <= before["shares"],
        div(now["revenue"] - now["cogs"], now["revenue"]) > div(before["revenue"] - before["cogs"], before["revenue"]), better("revenue", "total_assets"),
    ]
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))


def equity_cost(free: Column, beta: Column, premium: Column) -> Column:
    return free + beta * premium


def capital_cost(equity: Column, debt: Column, cost_of_equity: Column, cost_of_debt: Column, tax: Column) -> Column:
    """The average cost of capital, weighted by equity and debt; null without either."""
    return div(equity * cost_of_equity + debt * cost_of_debt * (1 - tax), equity + debt)


def grown(base: Column, rates: Sequence[Column]) -> Column:
    """What base grows to at one rate after the other, as an array of each year's figure."""
    out, level = [], base
    for r in rates:
        level = level * (1 + r)
        out.append(level)
    return F.array(*out)


def sharpe(x: Column, periods: float) -> Column:
    """Aggregate: mean over deviation, a year; 0 where nothing varies."""
    return F.when(F.stddev_samp(x) < 1e-12, 0.0).otherwise(div(F.avg(x), F.stddev_samp(x)) * periods**0.5)


def sortino(x: Column, periods: float) -> Column:
    """Aggregate: mean over the root mean square of what is below 0, a year; 0 where nothing is."""
    return F.coalesce(div(F.avg(x), F.sqrt(F.avg(F.when(x < 0, x * x)))) * periods**0.5, F.lit(0.0))


def kelly(wins: Column, odds: Column, part: float = 0.5) -> Column:
    """Part of the stake that grows wealth fastest, within 0 to 1; null unless wins lies between 0 and 1 and odds are above 0."""
    return F.when((wins > 0) & (wins < 1) & (odds > 0), F.least(F.greatest((wins - (1 - wins) / odds) * part, F.lit(0.0)), F.lit(1.0)))


def stressed(value: Column, exposures: Mapping[str, Column], shocks: Mapping[str, float]) -> Column:
    """value after each factor's shock times its exposure; a factor without exposure changes nothing."""
    return value * (1 + sum((F.coalesce(exposures[f], F.lit(0.0)) * s for f, s in shocks.items() if f in exposures), F.lit(0.0)))

"""Column functions: guarded arithmetic, ranks, the normal distribution, texts and dates."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def div(a: Column, b: Column | float) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b if isinstance(b, Column) else F.lit(b))


def clip(x: Column, low: float, high: float) -> Column:
    """x within low..high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def known(x: Column) -> Column:
    """x with NaN as null."""
    return F.when(~F.isnan(x), x)


def average_rank(x: str, *by: str) -> Column:
    """The rank from 1 of x within by, ties sharing the mean of their places; null for null, which takes no place."""
    group = W.partitionBy(*by, F.col(x).isNull())
    return F.when(F.col(x).isNotNull(), F.rank().over(group.orderBy(x)) + (F.count("*").over(W.partitionBy(*by, x)) - 1) / 2)


def percent_of(x: str, *by: str) -> Column:
    """average_rank over the number of values, from above 0 to 1."""
    return div(average_rank(x, *by), F.count(x).over(W.partitionBy(*by)))


def unit_rank(x: str, *by: str) -> Column:
    """(average_rank - 1) / (values - 1), from 0 to 1; 0 for a single value."""
    return (average_rank(x, *by) - 1) / F.greatest(F.count(x).over(W.partitionBy(*by)) - 1, F.lit(1))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson's r of the pairs, null if either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def ahead(x: str, n: int, w: WindowSpec) -> Column:
    """x n rows later over x now, less 1."""
    return div(F.lead(x, n).over(w), F.col(x)) - 1


def back(x: str, n: int, w: WindowSpec) -> Column:
    """x now over x n rows before, less 1."""
    return div(F.col(x), F.lag(x, n).over(w)) - 1


def over_rows(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return w.rowsBetween(-(n - 1), 0)


def at_least(value: Column, x: Column | str, w: WindowSpec, n: int) -> Column:
    """value where the frame has n values of x or more, else null."""
    return F.when(F.count(x).over(w) >= n, value)


# The polynomial of Abramowitz and Stegun 26.2.17, and Acklam's rational approximation of the inverse.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_cdf(z: Column) -> Column:
    """P(Z <= z), to about 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(_TAIL):
        poly = (poly + c) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """normal_cdf of a whole array, for functions that take columns in batches."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    upper = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * np.polyval(_TAIL[::-1], t)
    return np.where(z >= 0, 1 - upper, upper)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_ppf(p: Column) -> Column:
    """The z with P(Z <= z) = p, to about 1e-9; null outside 0 < p < 1."""
    low = 0.02425
    tail = lambda q: _horner(_C, q) / (_horner(_D, q) * q + 1)
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = _horner(_A, r) * q / (_horner(_B, r) * r + 1)
    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < low, tail(F.sqrt(-2 * F.log(p))))
        .when(p > 1 - low, -tail(F.sqrt(-2 * F.log(1 - p))))
        .otherwise(middle)
    )


def plain_text(x: Column) -> Column:
    """Lower case, plain quotes and dashes, single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.translate(x, "‘’“”–—", "''\"\"--"), r"\s+", " ")))


def numbers(x: Column) -> Column:
    """The signed numbers that a text writes, as `$1,234.5`, `-3` or `(12)`."""
    found = F.regexp_extract_all(x, F.lit(r"\(?-?\$?\d[\d,]*(?:\.\d+)?\)?"), F.lit(0))
    bare = lambda m: F.regexp_replace(m, r"[()$,\-]", "").cast("double")
    return F.transform(found, lambda m: F.when((m.startswith("(") & m.endswith(")")) | m.contains("-"), -bare(m)).otherwise(bare(m)))


def states(value: Column, quote: Column, scaled: bool = False) -> Column:
    """Whether the quote writes value, also with the other sign; if scaled also in thousandths or thousands."""
    targets = [value, -value] + ([value / 1000, value * 1000] if scaled else [])
    near = lambda c: F.greatest(*[F.abs(c - t) <= F.greatest(F.lit(0.005), 0.0005 * F.abs(t)) for t in targets])
    return F.exists(numbers(quote), near)


def visible_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags gone, entities resolved, single spaces."""
    x = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def short_hash(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def third_friday(day: Column) -> Column:
    """Of the month of day."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "FR"), 14)


def last_friday(day: Column) -> Column:
    return F.next_day(F.date_sub(F.last_day(day), 7), "FR")


def week_end(day: Column) -> Column:
    """The Friday on or after day."""
    return F.next_day(F.date_sub(day, 1), "FR")

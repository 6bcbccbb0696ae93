"""Flows of reporting periods: quarters that were never reported, cumulative figures taken apart, trailing years.

A fact is a stretch of days (start to finish, both included) and its figure. All stretches of an entity fit a window, since they are bounded by its calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Days of a quarter and of a year, from and to.
QUARTER, YEAR = (80, 100), (350, 380)


def _days() -> Column:
    return F.datediff("finish", "start") + 1


def fourth_quarters(facts: DataFrame, entity: str) -> DataFrame:
    """(entity, start, finish, value): a year's figure less those of the three quarters inside it, for years that have three and whose last quarter isn't there.

    facts has the columns entity, start, finish and value, one row for each stretch; years and quarters are told by their length in days. A quarter belongs
    to the year whose days hold it; where years overlap it belongs to each. Rows with a null are left out.
    """
    f = facts.select(F.col(entity).alias("e"), "start", "finish", "value").dropna()
    # each stretch in the calendar years it touches, two at most: quarters meet the years that may hold them without meeting all
    spread = lambda x: x.withColumn("at", F.explode(F.sequence(F.year("start"), F.year("finish"))))
    years = f.where(_days().between(*YEAR)).select("e", F.col("start").alias("y0"), F.col("finish").alias("y1"), F.col("value").alias("whole"))
    y = years.withColumn("at", F.explode(F.sequence(F.year("y0"), F.year("y1"))))
    q = spread(f.where(_days().between(*QUARTER)))
    inside = y.join(q, ["e", "at"]).where("start >= y0 and finish <= y1").groupBy("e", "y0", "y1", "whole", "start", "finish").agg(F.max("value").alias("value"))
    three = inside.groupBy("e", "y0", "y1", "whole").agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.max("finish").alias("last"))
    # the year's rest must itself be a quarter: then no quarter ends with the year
    rest = three.where("n = 3").where(F.datediff("y1", "last").between(*QUARTER))
    return rest.select(F.col("e").alias(entity), F.date_add("last", 1).alias("start"), F.col("y1").alias("finish"), (F.col("whole") - F.col("sum")).alias("value"))


def from_year_to_date(facts: DataFrame, entity: str) -> DataFrame:
    """(entity, start, finish, flow, trailing) of cumulative facts that begin with their year: what each adds to the one before, and the year that ends with it.

    trailing is the last full year plus this stretch less the same stretch a year before, the one that ends nearest to a year earlier within 15 days; null if
    either isn't known. The first stretch of a year is its own flow; a stretch that doesn't end a quarter after the one before has no flow of its own.
    """
    f = facts.select(F.col(entity).alias("e"), "start", "finish", "value").dropna()
    w = W.partitionBy("e", "start").orderBy("finish")
    x = f.withColumn("before", F.lag("value").over(w)).withColumn("until", F.lag("finish").over(w))
    step = F.datediff("finish", F.coalesce("until", F.date_sub("start", 1)))
    x = x.withColumn("flow", F.when(step.between(*QUARTER), F.col("value") - F.coalesce("before", F.lit(0.0))))
    earlier = f.groupBy("e", "start").agg(F.max_by("value", "finish").alias("year"), F.max("finish").alias("end"), F.collect_list(F.struct("finish", "value")).alias("ends"))  # a year's stretches
    earlier = earlier.where(F.datediff("end", "start").between(YEAR[0] - 1, YEAR[1] - 1)).select(F.col("e").alias("_e"), F.date_add("end", 1).alias("_next"), "year", "ends")
    x = x.join(earlier, (F.col("e") == F.col("_e")) & (F.col("start") == F.col("_next")), "left")
    off = lambda s: F.abs(F.datediff(F.add_months("finish", -12), s["finish"]))
    near = F.array_min(F.transform(F.filter("ends", lambda s: off(s) <= 15), lambda s: F.struct(off(s).alias("off"), s["finish"].alias("finish"), s["value"].alias("value"))))
    return x.select(F.col("e").alias(entity), "start", "finish", "flow", (F.col("year") + F.col("value") - near["value"]).alias("trailing"))

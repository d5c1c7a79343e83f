"""Exact quantiles of long groups without one buffer or task that holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: its ranks are off by n / ACCURACY at most; brackets reach REACH of these errors to both sides.
ACCURACY, REACH = 10_000, 3


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by..., n, one column a quantile) with linear interpolation between neighbours; null values are left out, and so are groups without a value. A null key is a group.

    A mergeable sketch brackets each quantile by two values. What lies outside the brackets is only counted, with its least and largest value; values inside are counted
    by value. Both are partial aggregations, and the final pick sorts, of each group, the distinct values of a few ten-thousandths of its rows.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    reach, points = REACH / ACCURACY, sorted(set(quantiles.values()))
    ends = [min(1.0, max(0.0, q + side * reach)) for q in points for side in (-1, 1)]
    borders = rows.groupBy(*by).agg(F.percentile_approx("__v", ends, ACCURACY).alias("__b"), F.count(F.lit(1)).alias("n"))
    if by:
        # A null key is a group as any other, so keys meet null-safely.
        named = borders.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(by)], "__b", "n")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__k{n}")) for n, c in enumerate(by)])
        bracketed = rows.join(named, same).drop(*[f"__k{n}" for n in range(len(by))])
    else:
        bracketed = rows.crossJoin(F.broadcast(borders))
    b = lambda k: F.col("__b")[k]
    inside = F.lit(False)
    gap = F.lit(0)
    for k in range(len(points)):
        inside = inside | F.col("__v").between(b(2 * k), b(2 * k + 1))
        gap = gap + (F.col("__v") > b(2 * k + 1)).cast("int")
    counted = bracketed.groupBy(*by, "n", F.when(inside, F.col("__v")).alias("__in"), F.when(~inside, gap).alias("__gap")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("__lo").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__c"))

    def at(rank):
        # A rank next to a bracket is the last or the first value of what lies outside it.
        holds = (F.col("__from") <= rank) & (rank < F.col("__to"))
        return F.max(F.when(holds, F.when(F.col("__in").isNotNull(), F.col("__in")).when(rank == F.col("__from"), F.col("__lo")).otherwise(F.col("__hi"))))

    out = {}
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        out[name] = low + (high - low) * share
    return placed.groupBy(*by, "n").agg(*[c.alias(name) for name, c in out.items()])


def exact_medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by..., n, name): the exact median of each group."""
    return exact_quantiles(df, by, value, {name: 0.5})

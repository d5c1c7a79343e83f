"""Positions in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_position(df: DataFrame, coarse: str, fine: list[str], name: str) -> DataFrame:
    """``df`` with its 0-based position in the order of (coarse, fine).

    ``coarse`` has few values next to the rows (a day, an hour): their counts are prefix-summed in one small window, and
    rows are numbered within their value.
    """
    counts = df.groupBy(coarse).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col(coarse).alias("__c"), (F.sum("__n").over(Window.orderBy(F.col(coarse).asc_nulls_first())) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(coarse).orderBy(*fine)) - 1
    return df.withColumn("__w", within).join(before, F.col(coarse).eqNullSafe(F.col("__c"))).withColumn(name, (F.col("__before") + F.col("__w")).cast("long")).drop("__w", "__c", "__before")

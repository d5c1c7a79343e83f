"""Flow and quality evidence in one score, where flow alone cannot tell stations apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.operators import topology as T

#: Cosine of two responses from which the stations count as confusable. Fixed value.
CONFUSABLE = 0.90


def ambiguous_groups(spark: SparkSession, ambiguity: DataFrame, threshold: float = CONFUSABLE) -> DataFrame:
    """(station, grp) of the stations that a chain of best rivals at ``threshold`` or more connects, each group named by its first station.

    ``ambiguity`` (station, ambiguity, confusable_with) has a row a station, so all of this is dimension data. A station that nobody is confused with is in no
    group; a rival that is no station of the table, and a null, link nothing.
    """
    known = ambiguity.select(F.col("station").alias("confusable_with"))
    near = ambiguity.where(F.col("ambiguity") >= threshold).join(F.broadcast(known), "confusable_with", "left_semi").where("station <> confusable_with")
    one = near.select(F.col("station").cast("int").alias("src"), F.col("confusable_with").cast("int").alias("dst"))
    both = one.union(one.select("dst", "src")).distinct()
    reach = T.reachable(spark, spark.createDataFrame(both.collect(), "src int, dst int"))  # at most two rows a station
    return reach.groupBy(F.col("src").alias("station")).agg(F.least(F.min("dst"), F.col("src")).alias("grp"))


def overlapping(left: DataFrame, right: DataFrame, bucket_s: float) -> DataFrame:
    """(window, other): windows of ``left`` and ``right``, both (window, t_lo, t_hi), that share a moment; touching ends do.

    Both sides are cut at time buckets and meet in an equi-join. A pair is kept in the one bucket in which the later of the two begins, so no pair comes twice and
    nothing has to be made distinct. Windows without bounds overlap nothing.
    """

    def cut(d: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        d = d.where("t_lo <= t_hi").toDF(*names)
        lo, hi = names[1:]
        return d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket_s), F.floor(F.col(hi) / bucket_s))))

    a = cut(left.select("window", "t_lo", "t_hi"), ("window", "a_lo", "a_hi"))
    b = cut(right.select("window", "t_lo", "t_hi"), ("other", "b_lo", "b_hi"))
    meet = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & (F.col("bucket") == F.floor(F.greatest("a_lo", "b_lo") / bucket_s))
    return a.join(b, "bucket").where(meet).select("window", "other")


def fuse(tops: DataFrame, flow_bounds: DataFrame, quality: DataFrame, quality_bounds: DataFrame, groups: DataFrame, bucket_s: float, digits: int = 9) -> DataFrame:
    """``tops`` (window, top_station, llr) with ``fused_top_station``, ``fused_llr_margin`` and ``is_fused``; the flow's own top stays as it is.

    A window is fused if its top is in a group of confusable stations and quality windows that overlap it hold a likelihood above 0 for one of the group. The
    score of a station of the group is what quality gives it over those windows and, for the flow's top, the flow's likelihood (null: 0). The largest score leads, of equal
    ones the first station; the margin is the distance to the second. Elsewhere the fused top is the flow's and the margin is null.

    ``quality`` (window, station, llr). The groups are of the station dimension and are broadcast; the quality rows are cut to their stations before they meet windows.
    """
    member = F.broadcast(groups.select("station", "grp"))
    lead = F.broadcast(groups.select(F.col("station").alias("top_station"), "grp"))
    asked = tops.join(lead, "top_station").select("window", "top_station", F.coalesce("llr", F.lit(0.0)).alias("own"), "grp")
    pairs = overlapping(flow_bounds, quality_bounds, bucket_s)
    held = quality.where("llr IS NOT NULL").join(member, "station").select(F.col("window").alias("other"), "station", "grp", F.col("llr").alias("q"))
    seen = asked.select("window", "grp").join(pairs, "window").join(held, ["other", "grp"]).groupBy("window", "station").agg(F.round(F.sum("q"), digits).alias("q"))
    scores = asked.join(member, "grp").join(seen, ["window", "station"], "left")
    own = F.when(F.col("station") == F.col("top_station"), F.col("own")).otherwise(0.0)
    scores = scores.withColumn("score", F.round(own + F.coalesce("q", F.lit(0.0)), digits))
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "station"))
    scores = scores.withColumn("rank", rank)
    at = lambda c, n: F.max(F.when(F.col("rank") == n, F.col(c)))
    best = scores.groupBy("window").agg(at("station", 1).alias("__best"), at("score", 1).alias("__s1"), F.coalesce(at("score", 2), F.lit(0.0)).alias("__s2"), F.max("q").alias("__q")).where("__q > 0")
    fused = best.select("window", "__best", (F.col("__s1") - F.col("__s2")).alias("fused_llr_margin"))
    out = tops.join(fused, "window", "left")
    return out.withColumns({"is_fused": F.col("__best").isNotNull(), "fused_top_station": F.coalesce(F.col("__best").cast("long"), F.col("top_station").cast("long"))}).drop("__best")

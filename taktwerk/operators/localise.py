"""Where the constraint is: the turning point, and likelihoods of every station, seen or not, as a join and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the likelihood: direct evidence normal(3.5, 3.0), null prior 0.90, floor of a channel's sum of squares, least observed stations.
FAULT_MEAN, FAULT_SD, NULL_PRIOR, INERT, LEAST_OBSERVED = 3.5, 3.0, 0.90, 1e-12, 4
#: Hypotheses beside the stations.
NULL, SUPPLY = -1, -2


def turning_point(scored: DataFrame, digits: int = 9) -> DataFrame:
    """(window, station, strength): the first station at which blocking has turned to starving.

    The difference of the two deviations (null counts as 0) changes from positive to negative between two neighbours; of several changes the largest drop
    counts, of equal ones the first, and the station after it is named. Without a change it is the first station if no difference is positive, else the last, with the largest
    absolute difference as strength. Windows with one station give no row.
    """
    w = Window.partitionBy("window").orderBy("station")
    d = scored.withColumn("diff", F.coalesce(F.round(F.col("d_blocked") - F.col("d_starved"), digits), F.lit(0.0)))
    d = d.withColumns({"next": F.lead("diff").over(w), "after": F.lead("station").over(w)})
    drop = F.when((F.col("diff") > 0) & (F.col("next") < 0), F.round(F.col("diff") - F.col("next"), digits))
    g = d.withColumn("drop", drop).groupBy("window").agg(
        F.max("diff").alias("top"), F.max_by("after", F.when(F.col("drop").isNotNull(), F.struct("drop", -F.col("station")))).alias("turn"), F.max("drop").alias("strength"), F.max(F.abs("diff")).alias("most"),
        F.min("station").alias("first"), F.max("station").alias("last"), F.count(F.lit(1)).alias("n"),
    )
    station = F.when(F.col("turn").isNotNull(), F.col("turn")).when(F.col("top") <= 0, F.col("first")).otherwise(F.col("last"))
    return g.where("n >= 2").select("window", station.alias("station"), F.coalesce("strength", "most").alias("strength"))


def hypothesis_scores(scored: DataFrame, prop: DataFrame, sigma_b: float, sigma_s: float, tau: float, supply_decay: float = 16.0) -> DataFrame:
    """(window, k, ll, amp_block, amp_starve, ll0): the log likelihood of each station's being the constraint (k >= 0), of no disturbance and of late supply.

    Each channel's amplitude is the least-squares one, not below 0; residual sums of squares follow from seven sums, so one broadcast join and one
    aggregation score all windows; windows are dealt out before the join, so its copies are summed where they lie. ``ll0`` is the window's null.
    A window with fewer than four observed stations gives no station or supply.
    """
    obs = scored.where("d_blocked IS NOT NULL AND d_starved IS NOT NULL").select("window", F.col("station").alias("i"), "d_blocked", "d_starved", "z_proc").repartition("window")
    x = obs.join(F.broadcast(prop), "i")
    b, s, db, ds = (F.col(c) for c in ("b", "s", "d_blocked", "d_starved"))
    p = F.exp(-F.col("dist") / supply_decay)
    sums = x.groupBy("window", "k").agg(
        F.sum(b * db).alias("bd"), F.sum(b * b).alias("bb"), F.sum(s * ds).alias("sd"), F.sum(s * s).alias("ss"), F.sum(db * db).alias("dd_b"), F.sum(ds * ds).alias("dd_s"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("i") == F.col("k"), F.coalesce("z_proc", F.lit(0.0)))).alias("z"), F.sum(p * ds).alias("pd"), F.sum(p * p).alias("pp"),
    )
    amp = lambda xy, yy: F.when(F.col(yy) > INERT, F.greatest(F.lit(0.0), F.col(xy) / F.col(yy))).otherwise(0.0)
    sums = sums.withColumns({"amp_block": amp("bd", "bb"), "amp_starve": amp("sd", "ss"), "a": amp("pd", "pp")})
    sse = lambda d, a, xy, yy: F.col(d) - 2 * F.col(a) * F.col(xy) + F.col(a) * F.col(a) * F.col(yy)
    flow = -0.5 * (sse("dd_b", "amp_block", "bd", "bb") / sigma_b**2 + sse("dd_s", "amp_starve", "sd", "ss") / sigma_s**2)
    z = F.col("z")
    direct = F.when(z.isNotNull(), -0.5 * ((z - FAULT_MEAN) / FAULT_SD) ** 2 - F.ln(F.lit(FAULT_SD)) + 0.5 * z * z).otherwise(0.0)
    # The first station's row has the sums over all stations, from which the null and late supply follow.
    first, enough = F.col("k") == 0, F.col("n") >= LEAST_OBSERVED
    quiet = F.when(enough, -0.5 * tau * (F.col("dd_b") / sigma_b**2 + F.col("dd_s") / sigma_s**2)).otherwise(0.0)
    late = -0.5 * tau * (F.col("dd_b") / sigma_b**2 + sse("dd_s", "a", "pd", "pp") / sigma_s**2)
    none = F.lit(None).cast("double")
    row = lambda k, ll, block, starve: F.struct(k.cast("long").alias("k"), ll.alias("ll"), block.alias("amp_block"), starve.alias("amp_starve"))
    rows = F.array(
        F.when(enough, row(F.col("k"), tau * flow + direct, F.col("amp_block"), F.col("amp_starve"))),
        F.when(first, row(F.lit(NULL), quiet, none, none)),
        F.when(first & enough, row(F.lit(SUPPLY), late, none, F.col("a"))),
    )
    ll0 = F.max(F.when(first, quiet)).over(Window.partitionBy("window"))
    return sums.select("window", ll0.alias("ll0"), F.explode(rows).alias("h")).where("h IS NOT NULL").select("window", F.col("h.k").cast(dict(prop.dtypes)["k"]).alias("k"), "h.ll", "h.amp_block", "h.amp_starve", "ll0")


def llr(scores: DataFrame) -> DataFrame:
    """``scores`` with ``llr``, the difference to the window's null."""
    return scores.where("ll0 IS NOT NULL").withColumn("llr", F.col("ll") - F.col("ll0")).drop("ll0")


def posterior(smoothed: DataFrame, n_stations: int, value: str = "llr_s") -> DataFrame:
    """``smoothed`` with ``post``: the null's prior is 0.90, the rest is shared by the stations and supply; log-sum-exp over a window."""
    prior = F.when(F.col("k") == NULL, F.ln(F.lit(NULL_PRIOR))).otherwise(F.ln(F.lit((1 - NULL_PRIOR) / (n_stations + 1))))
    w = Window.partitionBy("window")
    d = smoothed.withColumn("__l", F.col(value) + prior)
    d = d.withColumn("__e", F.exp(F.col("__l") - F.max("__l").over(w)))
    return d.withColumn("post", F.col("__e") / F.sum("__e").over(w)).drop("__l", "__e")


def top_and_runner_up(post: DataFrame, digits: int = 9) -> DataFrame:
    """(window, top_station, top_prob, runner_up_station, runner_up_prob) over the stations; ties go to the first."""
    r = F.row_number().over(Window.partitionBy("window").orderBy(F.desc(F.round("post", digits)), "k"))
    d = post.where("k >= 0").withColumn("r", r).where("r <= 2")
    pick = lambda c, n: F.max(F.when(F.col("r") == n, F.col(c)))
    return d.groupBy("window").agg(pick("k", 1).alias("top_station"), pick("post", 1).alias("top_prob"), pick("k", 2).alias("runner_up_station"), pick("post", 2).alias("runner_up_prob"))


def candidate_group(post: DataFrame, share: float = 0.25, digits: int = 9) -> DataFrame:
    """(window, top_station, group_lo, group_hi, group_prob): stations next to the top as far as each has ``share`` of its probability."""
    top = top_and_runner_up(post, digits).select("window", "top_station", "top_prob")
    d = post.where("k >= 0").join(top, "window")
    low = F.round("post", digits) < F.round(share * F.col("top_prob"), digits)
    ends = d.groupBy("window", "top_station").agg(
        (F.coalesce(F.max(F.when(low & (F.col("k") < F.col("top_station")), F.col("k"))), F.min("k") - 1) + 1).alias("group_lo"),
        (F.coalesce(F.min(F.when(low & (F.col("k") > F.col("top_station")), F.col("k"))), F.max("k") + 1) - 1).alias("group_hi"),
    )
    return d.join(ends, ["window", "top_station"]).where("k BETWEEN group_lo AND group_hi").groupBy("window", "top_station", "group_lo", "group_hi").agg(F.sum("post").alias("group_prob"))

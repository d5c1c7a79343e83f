"""Scores of predictions against the truth of episodes: localisation, false alarms, early warning, roll-ups.

Episodes are a dimension of a few rows an experiment; predictions are rows of windows. They meet in a range join on time, and every score is a grouped conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ELEVATED = ("WATCH", "PREDICTED", "ACTIVE")
NOT_A_STATION = "MATERIAL_DELAY"


def episode_truth(disturbances: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row an episode: its first disturbance that a station causes, and whether that station has no sensor; without one, ``has_fault`` is false and the rest null."""
    first = disturbances.where(F.col("kind") != NOT_A_STATION).groupBy("episode").agg(F.min_by(F.struct("station", "kind", "t_start_s", "t_end_s", "ramp_s", "magnitude", "board_moment_s"), "seq").alias("d"))
    d = disturbances.select("episode").distinct().join(first, "episode", "left").select("episode", F.col("d").isNotNull().alias("has_fault"), "d.*")
    return d.join(hidden.select("station", F.lit(True).alias("is_hidden")), "station", "left").withColumn("source_is_hidden", F.coalesce("is_hidden", F.lit(False))).drop("is_hidden")


def true_onset(truth: DataFrame, cycles: DataFrame, takt_s: float) -> DataFrame:
    """``truth`` with onset_s: when a slowdown's cycle first exceeds takt, on a linear ramp from its base cycle; null where it never does or is not defined."""
    need = takt_s / F.col("base_cycle_s")
    share = (need - 1) / (F.col("magnitude") - 1)
    usable = F.col("has_fault") & F.col("kind").isin("SLOWDOWN", "COMBINED") & (F.col("magnitude") > 1)
    onset = F.when(usable & (need <= 1), F.col("t_start_s")).when(usable & (share <= 1), F.col("t_start_s") + share * F.col("ramp_s"))
    return truth.join(cycles, "station", "left").withColumn("onset_s", onset).drop("base_cycle_s")


def _during(pred: DataFrame, truth: DataFrame, lo: str, hi: str) -> DataFrame:
    return pred.join(truth, (F.col("t_mid_s") >= F.expr(lo)) & (F.col("t_mid_s") <= F.expr(hi)))


def localisation(pred: DataFrame, truth: DataFrame, settle: float = 1.0) -> DataFrame:
    """One row a faulted episode with windows after its ramp: detection rate, how often and how far the named station is off, by window and by the episode's most named
    station, and the minutes that the first right alert since onset came before the board showed it."""
    fault = truth.where("has_fault")
    keep = ["episode", "station", "t_start_s", "board_moment_s"]
    during = _during(pred, fault, f"t_start_s + {settle} * ramp_s", "t_end_s")
    err = F.when(F.col("detected"), F.abs(F.col("top_station") - F.col("station")))
    base = during.groupBy(*keep).agg(F.count(F.lit(1)).alias("n_windows_during"), F.count_if("detected").alias("n_detected"), F.avg((err == 0).cast("double")).alias("top1"), F.avg((err <= 1).cast("double")).alias("within1"), F.median(err).alias("median_station_error"))
    votes = during.where("detected").groupBy("episode", "top_station").agg(F.count(F.lit(1)).alias("n")).groupBy("episode").agg(F.max_by("top_station", F.struct("n", -F.col("top_station"))).alias("modal"))
    right = _during(pred, fault, "t_start_s", "t_end_s").where("detected").groupBy("episode").agg(F.min(F.when(F.abs(F.col("top_station") - F.col("station")) <= 1, F.col("t_mid_s"))).alias("first_right"), F.min("t_mid_s").alias("first_any"))
    d = base.join(votes, "episode", "left").join(right, "episode", "left")
    off = F.abs(F.col("modal") - F.col("station"))
    found = F.col("n_detected") > 0
    return d.select(
        "episode", "n_windows_during", (F.col("n_detected") / F.col("n_windows_during")).alias("detection_rate"), found.cast("double").alias("detected_episode"), "top1", "within1", "median_station_error",
        F.when(found, (off == 0).cast("double")).otherwise(0.0).alias("top1_episode"), F.when(found, (off <= 1).cast("double")).otherwise(0.0).alias("within1_episode"),
        F.when(found, (F.col("board_moment_s") - F.col("first_right")) / 60).alias("lead_time_min"), F.when(found, F.col("first_any")).alias("first_alert_t_s"),
    )


def false_alarms(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(episode, n_quiet_windows, false_alarm_rate): share of detections in the windows outside the fault."""
    quiet = pred.crossJoin(F.broadcast(truth)).where("NOT has_fault OR t_mid_s < t_start_s OR t_mid_s > t_end_s")  # truth: one row an episode of an experiment
    return quiet.groupBy("episode").agg(F.count(F.lit(1)).alias("n_quiet_windows"), F.avg(F.col("detected").cast("double")).alias("false_alarm_rate"))


def early_warning(pred: DataFrame, truth: DataFrame, before_s: float = 3600.0) -> DataFrame:
    """One row an episode: missed, false_alarm, minutes from the first right warning, and from the first anywhere, to the onset. Without a fault any elevated state is a false alarm."""
    up = F.col("state").isin(*ELEVATED)
    near = _during(pred.where(up).withColumnRenamed("station", "named"), truth.where("has_fault"), f"t_start_s - {before_s}", "t_end_s")
    first = near.groupBy("episode").agg(F.min("t_mid_s").alias("any_s"), F.min(F.when(F.abs(F.col("named") - F.col("station")) <= 1, F.col("t_mid_s"))).alias("right_s"))
    total = pred.agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(up).alias("n_up"))
    d = truth.join(first, "episode", "left").crossJoin(F.broadcast(total))
    fault, hit = F.col("has_fault"), F.col("right_s").isNotNull()
    return d.select(
        "episode", "n_windows", F.when(fault, (~hit).cast("double")).alias("missed"), F.when(fault, 0.0).otherwise((F.col("n_up") > 0).cast("double")).alias("false_alarm"), F.when(~fault, F.col("n_up")).alias("n_false_alarm_windows"),
        F.when(fault, (F.col("onset_s") - F.col("right_s")) / 60).alias("lead_time_min"), F.when(fault, (F.col("onset_s") - F.col("any_s")) / 60).alias("lead_time_any_min"),
    )


def summarise(rows: DataFrame, by: list[str], skip: tuple[str, ...] = ("episode",)) -> DataFrame:
    """The mean of every number by ``by`` (null keys stay) and n_episodes."""
    numbers = [c for c, kind in rows.dtypes if c not in by and c not in skip and kind in ("int", "bigint", "double", "float")]
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numbers], F.count(F.lit(1)).alias("n_episodes"))


def rolled_up(rows: DataFrame, sets: list[list[str]], means: list[str]) -> DataFrame:
    """Means of ``means`` at several grains in one pass: grouping sets over all keys, with ``grain`` the keys in use."""
    keys = sorted({k for s in sets for k in s})
    rows.createOrReplaceTempView(view := f"rows_{abs(hash((id(rows), *keys)))}")
    try:
        grain = " || ".join(f"CASE WHEN grouping({k}) = 0 THEN '{k};' ELSE '' END" for k in keys)
        cols = ", ".join(f"avg({m}) AS {m}" for m in means)
        return rows.sparkSession.sql(f"SELECT {', '.join(keys)}, {grain} AS grain, {cols}, count(*) AS n FROM {view} GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in sets)})")
    finally:
        rows.sparkSession.catalog.dropTempView(view)


def nearest_middle(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """The row in the middle of each group: place n div 2 of n, from 0."""
    d = df.withColumns({"__r": F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return d.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(*keys, order, *cols)

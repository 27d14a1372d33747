"""Flags of states and their summary category, first rule that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchoring(q_a: DataFrame, q_b: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(state, anchoring): which parts' runs a state's blocks open, from the q-values of either part; a missing q is not met."""
    both = q_a.select("state", F.col("q").alias("qa")).join(q_b.select("state", F.col("q").alias("qb")), "state", "full")
    a, b = (F.coalesce(F.when(~F.isnan(c), F.col(c) < alpha), F.lit(False)) for c in ("qa", "qb"))
    return both.select("state", F.when(a & b, "ab_start_common").when(a, "a_start_specific").when(b, "b_start_specific").otherwise("none").alias("anchoring"))


def flags(dwell: DataFrame, recurrence: DataFrame, season_q: DataFrame, global_q: DataFrame, anchors: DataFrame, slopes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row a state with its flags; a missing or NaN statistic counts as not met.

    season_q and global_q (state, q) come from the variance partition, slopes (state, slope, q) from the sessions.
    """
    every = recurrence.select("state", "recurrence").join(dwell.select("state", "sub_hrf"), "state", "left").join(anchors, "state", "left")
    every = every.join(season_q.select("state", F.col("q").alias("qs")), "state", "left").join(global_q.select("state", F.col("q").alias("qg")), "state", "left")
    every = every.join(slopes.select("state", "slope", F.col("q").alias("qt")), "state", "left")
    met = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c) < alpha), F.lit(False))
    at = lambda kind: F.coalesce(F.col("anchoring") == kind, F.lit(False))
    return every.select(
        "state", "recurrence", F.coalesce("sub_hrf", F.lit(False)).alias("sub_hrf"), (F.col("recurrence") == 0).alias("unused"), at("ab_start_common").alias("run_onset"),
        at("a_start_specific").alias("a_anchored"), at("b_start_specific").alias("b_anchored"),
        (met("qt") & F.coalesce(F.col("slope") < 0, F.lit(False))).alias("session_trend_down"), (met("qt") & F.coalesce(F.col("slope") > 0, F.lit(False))).alias("session_trend_up"), met("qs").alias("season_structured"), met("qg").alias("global_trend"),
    )


def categories(rows: DataFrame, floor: float = 0.1) -> DataFrame:
    """The first that holds: unused, low_confidence (blocks shorter than the response), run_onset_anchored (either or
    both parts), season_temporal (seasonal and with a global trend), eligible_for_content_analysis (recurrence at or
    above the floor), rare."""
    name = (
        F.when(F.col("unused"), "unused").when(F.col("sub_hrf"), "low_confidence").when(F.col("run_onset") | F.col("a_anchored") | F.col("b_anchored"), "run_onset_anchored")
        .when(F.col("season_structured") & F.col("global_trend"), "season_temporal").when(F.col("recurrence") >= floor, "eligible_for_content_analysis").otherwise("rare")
    )
    return rows.withColumn("summary_category", name)


def annotate(rows: DataFrame, categorised: DataFrame) -> DataFrame:
    return rows.join(categorised.select("state", "summary_category"), "state", "left").withColumn("summary_category", F.coalesce("summary_category", F.lit("unknown")))

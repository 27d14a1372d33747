"""Joins of label sequences, occupancies and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides at the same place of the same run: each run is cut to its shorter side."""
    return left.join(right, ["run", "tr"])


def joint_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n) over the common places of common runs; labels below 0 count for no state."""
    both = positional(a.select("run", "tr", F.col("state").alias("a")), b.select("run", "tr", F.col("state").alias("b")))
    return both.where("a >= 0 and b >= 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def only_in(left: DataFrame, right: DataFrame, key: str = "state") -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def also_in(left: DataFrame, right: DataFrame, key: str = "state") -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def in_both(a: DataFrame, b: DataFrame, eligible: DataFrame, least: float = 0.01) -> DataFrame:
    """(state, fo_a, fo_b) of the eligible states whose pooled occupancy (state, pooled_fo) is `least` or more in both."""
    pick = lambda rows, name: rows.where(F.col("pooled_fo") >= least).select("state", F.col("pooled_fo").alias(name))
    return also_in(pick(a, "fo_a").join(pick(b, "fo_b"), "state"), eligible)


def mismatches(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left_value, right_value) where the sides differ or one has no row; equal nulls agree."""
    l, r = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("_l")), right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = l.join(r, key, "full")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("_l", "_r")


def mutually_valid(left: DataFrame, right: DataFrame) -> DataFrame:
    """(run, n_left, n_right) of all runs; raises if a run is missing on a side or its lengths differ."""
    n = lambda rows, name: rows.groupBy("run").agg(F.count(F.lit(1)).alias(name))
    both = n(left, "n_left").join(n(right, "n_right"), "run", "full")
    ok = F.col("n_left").eqNullSafe(F.col("n_right"))
    return both.withColumn("n_left", F.when(ok, F.col("n_left")).otherwise(F.raise_error(F.concat(F.lit("run without an equal on the other side: "), F.col("run").cast("string")))))


def boundary_reset(fo: DataFrame, sessions: DataFrame) -> DataFrame:
    """(state, reset): mean jump of the occupancy from a session's last run to the next session's first, in each subject.

    `sessions` has run, subject, session and acq_time.
    """
    order = Window.partitionBy("subject", "session").orderBy("acq_time", "run")
    back = Window.partitionBy("subject", "session").orderBy(F.desc("acq_time"), F.desc("run"))
    ends = sessions.withColumn("k", F.row_number().over(order)).withColumn("r", F.row_number().over(back))
    last = ends.where("r = 1").select("subject", "session", F.col("run").alias("last_run"))
    first = ends.where("k = 1").select("subject", (F.col("session") - 1).alias("session"), F.col("run").alias("first_run"))
    pairs = last.join(first, ["subject", "session"])
    x = pairs.join(fo.select(F.col("run").alias("last_run"), "state", F.col("fo").alias("before")), "last_run")
    y = x.join(fo.select(F.col("run").alias("first_run"), "state", F.col("fo").alias("after")), ["first_run", "state"])
    return y.groupBy("state").agg(F.avg(F.col("after") - F.col("before")).alias("reset"))


def switch_windows(blocks: DataFrame, series: DataFrame, a: int, b: int, length: int) -> DataFrame:
    """(dim, mean, n_switches): mean of the series (run, tr, dim, x) in windows of `length` TRs centred on direct switches
    between the states a and b."""
    order = Window.partitionBy("run").orderBy("block_index")
    at = blocks.withColumn("next_state", F.lead("state").over(order)).withColumn("t", F.lead("start_tr").over(order))
    hit = at.where(((F.col("state") == a) & (F.col("next_state") == b)) | ((F.col("state") == b) & (F.col("next_state") == a)))
    lo = F.greatest(F.lit(0), F.col("t") - length // 2)
    rows = hit.select("run", F.col("t"), F.explode(F.sequence(lo, lo + length - 1)).alias("tr")).join(series, ["run", "tr"])
    n = hit.agg(F.count(F.lit(1)).alias("n_switches"))
    return rows.groupBy("dim").agg(F.avg("x").alias("mean")).join(F.broadcast(n))  # one row

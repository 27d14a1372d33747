"""Occupancy and recurrence of states over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.02


def run_lengths(states: DataFrame) -> DataFrame:
    return states.groupBy("run").agg(F.count(F.lit(1)).alias("n_trs"))


def fractional_occupancy(states: DataFrame, n_states: int) -> DataFrame:
    """(run, state, n, n_trs, fo), dense: every run has all states, absent ones with 0.

    The counts are joined by sorting: Spark sizes them by their compressed files and would send many more rows through the driver.
    """
    counts = states.groupBy("run", "state").agg(F.count(F.lit(1)).alias("n"))
    spine = run_lengths(states).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return spine.hint("merge").join(counts, ["run", "state"], "left").select("run", "state", n.alias("n"), "n_trs", (n / F.col("n_trs")).alias("fo"))


def recurrence(fo: DataFrame, threshold: float = THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of runs in which a state's occupancy is strictly above the threshold, with the mean occupancy."""
    return fo.groupBy(*by, "state").agg(F.avg((F.col("fo") > threshold).cast("double")).alias("recurrence"), F.avg("fo").alias("mean_fo"))


def active_states(fo: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return recurrence(fo, threshold).where("recurrence > 0").select("state")


def presence(fo: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Largest and mean occupancy and active runs of the states that pass the threshold anywhere."""
    out = fo.groupBy("state").agg(F.max("fo").alias("max_fo"), F.avg("fo").alias("mean_fo"), F.sum((F.col("fo") > threshold).cast("long")).alias("n_active_runs"))
    return out.where(F.col("max_fo") > threshold)


def pooled_occupancy(states: DataFrame) -> DataFrame:
    counts = states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("state", "n", (F.col("n") / F.col("total")).alias("pooled_fo"))  # one row


def specificity(season_recurrence: DataFrame) -> DataFrame:
    """Largest less smallest seasonal recurrence; 0 with fewer than two seasons."""
    spread = F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.max("recurrence") - F.min("recurrence"))
    return season_recurrence.groupBy("state").agg(spread.alias("specificity"))


def seasonal_breakdown(season_recurrence: DataFrame, high: float = 0.7) -> DataFrame:
    """Per state: seasons active, seasons at or above `high`, and whether it is across or seasonal."""
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.col("season")))), lambda s: s.cast("string")), ",")
    out = season_recurrence.groupBy("state").agg(
        listed(F.col("recurrence") > 0).alias("active_seasons"), listed(F.col("recurrence") >= high).alias("recurrent_seasons"),
        F.sum((F.col("recurrence") >= high).cast("int")).alias("n_recurrent"), F.count(F.lit(1)).alias("n_seasons"),
    )
    return out.withColumn("across", F.col("n_recurrent") == F.col("n_seasons")).withColumn("seasonal", (F.col("n_recurrent") > 0) & (F.col("n_recurrent") < F.col("n_seasons")))


def rolled_up(fo: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Length-weighted occupancy of groups of runs."""
    return fo.groupBy(*keys, "state").agg((F.sum("n") / F.sum("n_trs")).alias("fo"), F.sum("n_trs").alias("n_trs"))


def broadcast_episode(runs: DataFrame) -> DataFrame:
    """Adds broadcast_episode: in episodes that have a part c, parts c and d belong to the next one."""
    four = F.max((F.col("part") == "c").cast("int")).over(Window.partitionBy("season", "episode")) == 1
    return runs.withColumn("broadcast_episode", F.when(four & F.col("part").isin("c", "d"), F.col("episode") + 1).otherwise(F.col("episode")))


def run_metrics(states: DataFrame, fo: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per run: states seen, states active, blocks, states revisited, re-entries, blocks a state."""
    per_state = blocks.groupBy("run", "state").agg(F.count(F.lit(1)).alias("k"))
    seen = per_state.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("k").alias("n_blocks"), F.sum((F.col("k") > 1).cast("long")).alias("n_revisited"), F.sum(F.col("k") - 1).alias("n_reentries")
    )
    active = fo.groupBy("run").agg(F.sum((F.col("fo") > threshold).cast("long")).alias("n_active"))
    return seen.join(active, "run").withColumn("blocks_per_state", F.col("n_blocks") / F.col("n_unique"))


def third_drift(states: DataFrame, n_states: int) -> DataFrame:
    """Per run the sum over states of |occupancy of the first third - of the last third|."""
    n = run_lengths(states)
    third = F.floor(F.col("n_trs") / 3)
    part = states.join(n, "run").withColumn("third", third).where((F.col("tr") < third) | (F.col("tr") >= F.col("n_trs") - third))
    early = (F.col("tr") < F.col("third")).cast("int")
    per = part.groupBy("run", "third", "state").agg(F.sum(early).alias("e"), F.sum(1 - early).alias("l"))
    return per.groupBy("run").agg(F.sum(F.abs(F.col("e") - F.col("l")) / F.col("third")).alias("drift"))


def clr(fo: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Centred log-ratio of the occupancies of each run."""
    x = F.ln(F.col("fo") + eps)
    return fo.select("run", "state", (x - F.avg(x).over(Window.partitionBy("run"))).alias("clr"))


def lag1(fo: DataFrame, order: str = "run") -> DataFrame:
    """Lag-1 autocorrelation of each state's occupancy over runs, and the effective number of runs n(1-r)/(1+r)."""
    before = F.lag("fo").over(Window.partitionBy("state").orderBy(order))
    pairs = fo.withColumn("before", before)
    out = pairs.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.corr("fo", "before").alias("r"))
    return out.withColumn("n_eff", F.greatest(F.lit(2.0), F.least(F.col("n").cast("double"), F.col("n") * (1 - F.col("r")) / (1 + F.col("r")))))


def chronological_lag1(fo: DataFrame, order: list[str]) -> DataFrame:
    """(state, n, r, mean_r, n_eff): lag-1 correlation of each state's occupancy over runs in the order given, its mean over the
    states where it is defined, and the effective number of runs n (1 - r) / (1 + r) by that mean, not clamped; null at |r| = 1."""
    before = F.lag("fo").over(Window.partitionBy("state").orderBy(*order))
    one = fo.withColumn("before", before).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.corr("fo", "before").alias("r"))
    one = one.withColumn("r", F.when(~F.isnan("r"), F.col("r")))
    both = one.join(F.broadcast(one.agg(F.avg("r").alias("mean_r"))))  # one row
    return both.select("state", "n", "r", "mean_r", F.when(F.abs("mean_r") < 1, F.col("n") * (1 - F.col("mean_r")) / (1 + F.col("mean_r"))).alias("n_eff"))


def sessions(runs: DataFrame, gap_days: float = 7.0, by: str = "subject") -> DataFrame:
    """Adds session (from 0): a subject's runs in time order; a new session starts when the gap to the run before is strictly larger."""
    order = Window.partitionBy(by).orderBy("acq_time", "run")
    new = (F.col("acq_time") - F.lag("acq_time").over(order) > gap_days).cast("int")
    return runs.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(order))


def low_confidence(states: DataFrame, least: int = 10) -> DataFrame:
    """(state, n_trs) of the states that occur, but in fewer than `least` TRs over all runs."""
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n_trs")).where(F.col("n_trs") < least)


def mean_when_active(fo: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Mean occupancy over the runs in which a state is active; 0 for a state that never is."""
    return fo.groupBy("state").agg(F.coalesce(F.avg(F.when(F.col("fo") > threshold, F.col("fo"))), F.lit(0.0)).alias("mean_fo_active"))


def decile_table(states: DataFrame, n_states: int) -> DataFrame:
    """(state, decile, n): dense counts over ten equal parts of the runs."""
    at = states.join(run_lengths(states), "run")
    tenth = F.least(F.lit(9), F.floor(F.col("tr") * 10 / F.col("n_trs"))).cast("int")
    counts = at.groupBy("state", tenth.alias("decile")).agg(F.count(F.lit(1)).alias("n"))
    spine = states.sparkSession.range(n_states).select(F.col("id").cast("int").alias("state"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("decile"))
    return spine.join(counts, ["state", "decile"], "left").select("state", "decile", F.coalesce("n", F.lit(0)).alias("n"))

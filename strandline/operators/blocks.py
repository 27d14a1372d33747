"""Run-length blocks of states, visits and change sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TR_SECONDS = 1.49

def _order():
    return Window.partitionBy("run").orderBy("tr")


def state_blocks(states: DataFrame, seconds: float = TR_SECONDS) -> DataFrame:
    """(run, block_index, state, start_tr, end_tr, duration_tr, start_s, end_s, duration_s); end_tr is past the block."""
    change = F.coalesce((F.col("state") != F.lag("state").over(_order())).cast("int"), F.lit(0))
    marked = states.withColumn("changed", change).withColumn("block_index", F.sum("changed").over(_order()))
    out = marked.groupBy("run", "block_index").agg(F.first("state").alias("state"), F.min("tr").alias("start_tr"), (F.max("tr") + 1).alias("end_tr"))
    out = out.withColumn("duration_tr", F.col("end_tr") - F.col("start_tr"))
    return out.select("run", "block_index", "state", "start_tr", "end_tr", "duration_tr", *[(F.col(f"{c}_tr") * seconds).alias(f"{c}_s") for c in ("start", "end", "duration")])


def visits(blocks: DataFrame) -> DataFrame:
    """Blocks with the states before and after; -1 at the edges of a run."""
    by = Window.partitionBy("run").orderBy("block_index")
    return blocks.withColumn("prev_state", F.lag("state", 1, -1).over(by)).withColumn("next_state", F.lead("state", 1, -1).over(by))


def run_state_summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("run", "state").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("start_tr").alias("first_tr"), F.max("end_tr").alias("last_tr"), F.sum("duration_tr").alias("total_tr"), F.avg("duration_tr").alias("mean_tr")
    )


def dwell(blocks: DataFrame, short: int = 3) -> DataFrame:
    """Per state: blocks, mean, median and sample deviation of dwell, share of short blocks, and whether the median is short."""
    d = F.col("duration_tr").cast("double")
    out = blocks.groupBy("state").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.avg(d).alias("mean_dwell"), F.median(d).alias("median_dwell"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd_dwell"), F.avg((d < short).cast("double")).alias("frac_short")
    )
    return out.withColumn("sub_hrf", F.col("median_dwell") < short)


def change_sequence(blocks: DataFrame, min_dwell: int = 2) -> DataFrame:
    """(run, pos, state): blocks shorter than `min_dwell` go first, then equal neighbours merge."""
    by = Window.partitionBy("run").orderBy("block_index")
    long = blocks.where(F.col("duration_tr") >= min_dwell).withColumn("before", F.lag("state").over(by))
    kept = long.where(F.col("before").isNull() | (F.col("before") != F.col("state")))
    return kept.select("run", (F.row_number().over(by) - 1).alias("pos"), "state")


def collapse_flicker(states: DataFrame, longest: int = 4) -> DataFrame:
    """(run, tr, state): an inner block of at most `longest` between equal neighbours takes their state, left to right.

    The decision on a block sees the earlier ones already made, so each run's blocks (not its rows) fold in order, as
    an array of one row a run; the rows take their block's label by an equi-join.
    """
    blocks = state_blocks(states).select("run", "block_index", "state", "duration_tr", "start_tr", "end_tr")
    listed = blocks.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("block_index", "state", "duration_tr", "start_tr", "end_tr"))).alias("b"))
    def step(labels, k):
        own, before = F.get("b", k), F.get(labels, F.size(labels) - 1)
        last = F.get("b", k + 1)["state"]
        hides = (k > 0) & last.isNotNull() & (own["duration_tr"] <= longest) & (before == last)
        return F.concat(labels, F.array(F.when(hides, before).otherwise(own["state"])))

    start = F.array().cast("array<int>")
    folded = listed.select("run", "b", F.aggregate(F.sequence(F.lit(0), F.size("b") - 1), start, step).alias("labels"))
    each = folded.select("run", F.explode(F.arrays_zip("b", "labels")).alias("z")).select("run", F.col("z.b.start_tr").alias("s"), F.col("z.b.end_tr").alias("e"), F.col("z.labels").alias("state"))
    return each.select("run", F.explode(F.sequence("s", F.col("e") - 1)).alias("tr"), "state")


def position_metrics(blocks: DataFrame, lengths: DataFrame, early: float = 0.2) -> DataFrame:
    """Per state: mean relative block start, its quartile range, share of early blocks, runs."""
    at = blocks.join(lengths, "run").withColumn("p", F.col("start_tr") / F.col("n_trs"))
    return at.groupBy("state").agg(
        F.avg("p").alias("mean_position"), (F.percentile("p", 0.75) - F.percentile("p", 0.25)).alias("iqr_position"), F.avg((F.col("p") < early).cast("double")).alias("early_fraction"), F.countDistinct("run").alias("n_runs")
    )


def module_dwell(modules: DataFrame) -> DataFrame:
    """(module, mean_dwell, n_blocks) of a coarser labelling; labels below 0 belong to none and end a stay."""
    stays = state_blocks(modules).where("state >= 0")
    return stays.groupBy(F.col("state").alias("module")).agg(F.avg("duration_tr").alias("mean_dwell"), F.count(F.lit(1)).alias("n_blocks"))


def run_boundaries(lengths: DataFrame, by: str) -> DataFrame:
    """Adds first and past: where each run begins and ends if the runs of a `by` stand one after another."""
    upto = F.sum("n_trs").over(Window.partitionBy(by).orderBy("run"))
    return lengths.withColumn("first", upto - F.col("n_trs")).withColumn("past", upto)

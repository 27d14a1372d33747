"""Row-level transforms of time series, labels and occupancies within runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TR_SECONDS = 1.49


def zscored(rows: DataFrame, value: str = "x", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Adds z: deviation from the group's mean over its population deviation (a deviation of 0 counts as 1); null and NaN stay out of both."""
    group = Window.partitionBy(*by)
    x = F.when(~F.isnan(value), F.col(value))
    spread = F.stddev_pop(x).over(group)
    return rows.withColumn("z", (x - F.avg(x).over(group)) / F.when(spread == 0, 1.0).otherwise(spread))


def lagged(rows: DataFrame, lag: int, value: str = "x") -> DataFrame:
    """Each run's series `lag` TRs later; its head is zero."""
    return rows.withColumn(value, F.lag(value, lag, 0.0).over(Window.partitionBy("run").orderBy("tr")))


def without_onsets(rows: DataFrame, n: int, parts: tuple[str, ...] | None = None) -> DataFrame:
    """Rows without the first `n` TRs of the runs that are longer than that; with `parts`, only of runs of those parts."""
    length = F.count(F.lit(1)).over(Window.partitionBy("run"))
    cut = (F.col("_length") > n) & (F.col("tr") < n)
    return rows.withColumn("_length", length).where(~(cut & F.col("part").isin(*parts) if parts else cut)).drop("_length")


def timing_design(rows: DataFrame) -> DataFrame:
    """(run, tr, onset, pos, pos_sq, pos_cu, episode_norm, season_norm): timing-only columns, each within 0..1.

    Episodes are numbered over all runs in order of season, episode and part; a run of one TR has position 0.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("run"))
    at = F.when(F.col("n") > 1, F.col("tr") / (F.col("n") - 1)).otherwise(0.0)
    order = rows.select("run", "season", "episode", "part").distinct().withColumn("i", F.row_number().over(Window.orderBy("season", "episode", "part", "run")) - 1)  # one row a run
    last = F.broadcast(order.agg(F.max("i").alias("last"), F.max("season").alias("seasons")))
    whole = rows.select("run", "tr", "season").withColumn("n", n).join(order.select("run", "i"), "run").join(last)
    scaled = lambda c, top: F.when(F.col(top) > 0, F.col(c) / F.col(top)).otherwise(F.col(c).cast("double"))
    return whole.withColumn("pos", at).select(
        "run", "tr", (F.col("tr") == 0).cast("double").alias("onset"), "pos", (F.col("pos") * F.col("pos")).alias("pos_sq"), (F.col("pos") * F.col("pos") * F.col("pos")).alias("pos_cu"),
        scaled("i", "last").alias("episode_norm"), scaled("season", "seasons").alias("season_norm"),
    )


def residual(rows: DataFrame, y: str, x: str, by: tuple[str, ...]) -> DataFrame:
    """Adds residual: y less its least-squares line on x in each group; y itself where x does not vary; null where either is."""
    fit = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    line = F.when(F.col("_b").isNull(), F.col(y)).otherwise(F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    return rows.join(fit, list(by)).withColumn("residual", F.when(F.col(x).isNotNull(), line)).drop("_a", "_b")


def relabelled(states: DataFrame, mapping: DataFrame) -> DataFrame:
    """States by their place in `mapping` (state, position); -1 for those that it leaves out."""
    return states.join(mapping.select("state", "position"), "state", "left").select("run", "tr", F.coalesce("position", F.lit(-1)).cast("int").alias("state"))


def detrended(fo: DataFrame, slopes: DataFrame, index: DataFrame) -> DataFrame:
    """(run, state, fo, clipped): occupancy less slope times the run's centred index, not below 0 and not renormalised.

    A missing or NaN slope or index leaves the occupancy; clipped is what the floor took.
    """
    fixed = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    joined = fo.join(slopes.select("state", "slope"), "state", "left").join(index.select("run", "centred"), "run", "left")
    plain = F.col("fo") - fixed("slope") * fixed("centred")
    return joined.select("run", "state", F.greatest(F.lit(0.0), plain).alias("fo"), F.greatest(F.lit(0.0), -plain).alias("clipped"))


def pooled_frames(frames: DataFrame, lengths: DataFrame, rate: float, onset: float = 0.0, seconds: float = TR_SECONDS) -> DataFrame:
    """(run, tr, x): mean of the frames (run, frame, x) in each TR of (run, n_trs), counted from the scan's start.

    Both ends are cut to whole frames; a TR before the onset or without frames is 0.
    """
    per, shift = seconds * rate, onset * rate
    spine = lengths.select("run", F.explode(F.sequence(F.lit(0), F.col("n_trs").cast("int") - 1)).alias("tr"))
    begin, end = ((F.col("tr") + k) * per - shift for k in (0, 1))
    spine = spine.withColumn("lo", F.greatest(F.lit(0), begin.cast("int"))).withColumn("hi", end.cast("int"))
    near = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("frame")  # a TR holds few frames, so an equi-join serves
    held = spine.where("hi > lo").select("run", "tr", near).join(frames, ["run", "frame"]).groupBy("run", "tr").agg(F.avg("x").alias("x"))
    return spine.select("run", "tr").join(held, ["run", "tr"], "left").select("run", "tr", F.coalesce("x", F.lit(0.0)).alias("x"))


def trailing_tokens(tokens: DataFrame, boundaries: DataFrame, window: int, bos: int = 1) -> DataFrame:
    """(run, tr, x): mean of the tokens (run, tok, x) in the last `window` TRs, by the cumulated token counts
    (run, tr, n_tokens); the first `bos` tokens never count and an empty window is 0.

    Prefix sums a token stand for the range: a window is the difference of two of them.
    """
    upto = Window.partitionBy("run").orderBy("tok").rowsBetween(Window.unboundedPreceding, 0)
    sums = tokens.where(F.col("tok") >= bos).select("run", (F.col("tok") + 1).alias("at"), F.sum("x").over(upto).alias("s"))
    order = Window.partitionBy("run").orderBy("tr")
    size = tokens.groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    spans = boundaries.join(size, "run").select(
        "run", "tr", F.least(F.col("n_tokens"), F.col("size")).alias("hi"), F.greatest(F.lit(bos), F.coalesce(F.lag("n_tokens", window).over(order), F.lit(0))).alias("lo")
    )
    ended = spans.join(sums.select("run", F.col("at").alias("hi"), F.col("s").alias("s_hi")), ["run", "hi"], "left")
    both = ended.join(sums.select("run", F.col("at").alias("lo"), F.col("s").alias("s_lo")), ["run", "lo"], "left")
    mean = (F.coalesce("s_hi", F.lit(0.0)) - F.coalesce("s_lo", F.lit(0.0))) / (F.col("hi") - F.col("lo"))
    return both.select("run", "tr", F.when(F.col("hi") > F.col("lo"), mean).otherwise(0.0).alias("x"))


def replaced(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The column from `table` (run, tr, column), demeaned in its run; the old values where it has no row."""
    new = table.select("run", "tr", (F.col(column) - F.avg(column).over(Window.partitionBy("run"))).alias("_new"))
    return rows.join(new, ["run", "tr"], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def config_grid(spark, gammas: list[float], covariances: list[str], components: list[int]) -> DataFrame:
    """(gamma, covariance, n_components, name) of all combinations; a few literal rows."""
    lists = F.array(*map(F.lit, gammas)), F.array(*map(F.lit, covariances)), F.array(*map(F.lit, components))
    rows = spark.range(1).select(F.explode(lists[0]).alias("gamma"), F.lit(0).alias("z")).select("gamma", F.explode(lists[1]).alias("covariance")).select("gamma", "covariance", F.explode(lists[2]).alias("n_components"))
    return rows.withColumn("name", F.concat(F.lit("g"), F.col("gamma").cast("string"), F.lit("_"), F.col("covariance"), F.lit("_nc"), F.col("n_components").cast("string")))


def finite(column: str | Column) -> Column:
    """The value, or null for NaN and the infinities, as a text format without them needs it."""
    x = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

"""Selections over score tables: best cells, fronts, profiles and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, score: str, n: int, tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The `n` highest scores of each group, ties to the smaller `tie`; without groups a global limit."""
    if not by:
        return rows.orderBy(F.desc(score), tie).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def best_cell(rows: DataFrame, score: str, order: tuple[str, ...], excluded: tuple[int, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Each group's best row by `score`, the first in `order` on ties; null and NaN scores and the excluded first keys do not compete."""
    open_ = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & ~F.col(order[0]).isin(*excluded))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *order))
    return open_.withColumn("_r", rank).where("_r = 1").drop("_r")


def pareto_front(rows: DataFrame, gain: str, cost: str) -> DataFrame:
    """Rows that no other beats: none has as much gain for less cost, or more gain for as little."""
    cheaper = Window.orderBy(cost).rangeBetween(Window.unboundedPreceding, -1)
    best = rows.groupBy(cost).agg(F.max(gain).alias("_top")).withColumn("_before", F.max("_top").over(cheaper))  # one row a cost
    return rows.join(best, cost).where((F.col(gain) == F.col("_top")) & (F.col("_before").isNull() | (F.col(gain) > F.col("_before")))).drop("_top", "_before")


def centroid(rows: DataFrame, index: str, value: str, by: tuple[str, ...], chance: float = 0.5) -> DataFrame:
    """Mean index weighted by what is above chance; null where nothing is."""
    w = F.greatest(F.col(value) - chance, F.lit(0.0))
    return rows.groupBy(*by).agg((F.sum(F.col(index) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("centroid"))


def selectivity_profile(rows: DataFrame, index: str, value: str, by: tuple[str, ...]) -> DataFrame:
    """Per group: peak (the first on ties), its value, how far it is above the median, and the entropy of the shifted values."""
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), index))
    shifted = F.col(value) - F.min(value).over(Window.partitionBy(*by))
    total = F.sum("_s").over(Window.partitionBy(*by))
    p = F.col("_s") / F.nullif(F.col("_t"), F.lit(0.0))
    out = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_r", order).withColumn("_s", shifted).withColumn("_t", total).groupBy(*by).agg(
        F.max(F.when(F.col("_r") == 1, F.col(index))).alias("peak"), F.max(value).alias("peak_value"), (F.max(value) - F.median(value)).alias("max_minus_median"),
        (-F.sum(F.when(p > 0, p * F.ln(p)))).alias("entropy"), F.count(F.lit(1)).alias("n"),
    )
    return out.where("n >= 2").drop("n")


def effect_size(observed: str, n_classes: str) -> F.Column:
    """(observed - chance) / (1 - chance); null under two classes."""
    chance = 1 / F.col(n_classes)
    return F.when(F.col(n_classes) >= 2, (F.col(observed) - chance) / (1 - chance))


def fold_consistency(rows: DataFrame, metric: str, bounded: tuple[str, ...] = ()) -> DataFrame:
    """(metric, n, mean, sd, cv, low, high) over folds of (metric, value); no cv for bounded metrics or a mean of 0."""
    out = rows.groupBy(metric).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.withColumn("cv", F.when(~F.col(metric).isin(*bounded) & (F.col("mean") != 0), F.col("sd") / F.abs("mean")))


def likelihood_summary(runs: DataFrame, n_states: int) -> DataFrame:
    """(type, n_runs, per_tr, run_mean, run_sd, run_se, baseline) of runs (type, ll, n_trs): per type, and overall as type null.

    per_tr weighs runs by their TRs; the run figures take each run's mean; baseline is the log of one in n_states.
    """
    per = F.col("ll") / F.col("n_trs")
    return runs.rollup("type").agg(
        F.count(F.lit(1)).alias("n_runs"), (F.sum("ll") / F.sum("n_trs")).alias("per_tr"), F.avg(per).alias("run_mean"), F.stddev_samp(per).alias("run_sd"),
        (F.stddev_samp(per) / F.sqrt(F.count(F.lit(1)))).alias("run_se"), F.ln(F.lit(1.0 / n_states)).alias("baseline"),
    )


def jensen_shannon(left: DataFrame, right: DataFrame) -> DataFrame:
    """Divergence in bits of two share tables (state, share)."""
    both = left.select("state", F.col("share").alias("a")).join(right.select("state", F.col("share").alias("b")), "state", "full").na.fill(0.0, ["a", "b"])
    m = (F.col("a") + F.col("b")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return both.agg((F.sum(part("a") + part("b")) / 2).alias("js"))


def rv_coefficient(long: DataFrame, item: str = "state", i: str = "i", j: str = "j", value: str = "c") -> DataFrame:
    """(a, b, rv) for a < b: trace ratio of symmetric matrices given as (item, i, j, value); within 0..1, null for a zero matrix."""
    own = long.groupBy(item).agg(F.sum(F.col(value) * F.col(value)).alias("s"))
    x = long.select(F.col(item).alias("a"), i, j, F.col(value).alias("x"))
    y = long.select(F.col(item).alias("b"), i, j, F.col(value).alias("y"))
    dot = x.join(y, [i, j]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    both = dot.join(own.select(F.col(item).alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col(item).alias("b"), F.col("s").alias("sb")), "b")
    low = F.sqrt(F.col("sa") * F.col("sb"))
    return both.select("a", "b", F.when(low > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d") / low))).alias("rv"))


def blend_fit(long: DataFrame, target: int, a: int, b: int, item: str = "state", dim: str = "dim", value: str = "mean") -> DataFrame:
    """(w_a, w_b, r2_blend, delta_r2): least squares of one standardised map on two others without intercept, from the three correlations."""
    pick = lambda k, name: long.where(F.col(item) == k).select(dim, F.col(value).alias(name))
    r = pick(target, "s").join(pick(a, "a"), dim).join(pick(b, "b"), dim).agg(F.corr("s", "a").alias("ra"), F.corr("s", "b").alias("rb"), F.corr("a", "b").alias("rab"))
    det = 1 - F.col("rab") * F.col("rab")
    out = r.withColumn("w_a", (F.col("ra") - F.col("rb") * F.col("rab")) / det).withColumn("w_b", (F.col("rb") - F.col("ra") * F.col("rab")) / det)
    r2 = F.col("w_a") * F.col("ra") + F.col("w_b") * F.col("rb")
    return out.select("w_a", "w_b", r2.alias("r2_blend"), (r2 - F.greatest(F.col("ra") * F.col("ra"), F.col("rb") * F.col("rb"))).alias("delta_r2"))


def block_reference(fo: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """(season, first, l1): every block of `k` runs in a row of a season against the season's other runs, as the sum over
    states of the difference of mean occupancies; seasons of fewer than 2k runs are left out. `runs` has run, season
    and place (from 0 in the season)."""
    size = runs.groupBy("season").agg(F.count(F.lit(1)).alias("m"))
    each = fo.join(runs, "run").join(size, "season").where(F.col("m") >= 2 * k)
    order = Window.partitionBy("season", "state").orderBy("place").rowsBetween(0, k - 1)
    inside = each.withColumn("s", F.sum("fo").over(order)).withColumn("total", F.sum("fo").over(Window.partitionBy("season", "state"))).where(F.col("place") <= F.col("m") - k)
    gap = F.abs(F.col("s") / k - (F.col("total") - F.col("s")) / (F.col("m") - k))
    return inside.groupBy("season", F.col("place").alias("first")).agg(F.sum(gap).alias("l1"))


def config_metrics(fits: DataFrame, seasons: DataFrame, n_dims: int, gap_weight: float = 0.5) -> DataFrame:
    """One row a configuration (gamma, nc) of fits (gamma, nc, seed, train_ll, valid_ll, k_active, n_train): six scores, all
    better when higher, their ranks (1 best, ties share the lower) and the mean rank.

    The scores are the best seed's validation likelihood, a penalised training likelihood of a diagonal model, twice the
    validation less the training likelihood, validation likelihood a state, less a share of the gap, and the best seed's
    lowest validation likelihood of a season (`seasons`: gamma, nc, seed, season, valid_ll; null where it has none).
    """
    pick = lambda by: F.min_by(F.struct("train_ll", "valid_ll", "k_active", "n_train", "seed"), F.struct(-F.col(by), F.col("seed")))
    best = fits.groupBy("gamma", "nc").agg(pick("valid_ll").alias("v"), pick("train_ll").alias("t"), F.count(F.lit(1)).alias("n_seeds"))
    worst = seasons.groupBy("gamma", "nc", "seed").agg(F.min("valid_ll").alias("worst_season"))
    best = best.withColumn("seed", F.col("v.seed")).join(worst, ["gamma", "nc", "seed"], "left")
    k, n = F.col("t.k_active"), F.col("t.n_train")
    n_params = 2 * k * n_dims + k * (k - 1) + (k - 1)
    valid, train = F.col("v.valid_ll"), F.col("v.train_ll")
    out = best.select(
        "gamma", "nc", "n_seeds", F.col("v.k_active").alias("k_valid"), k.alias("k_train"), valid.alias("m1"), F.when(n > 1, F.col("t.train_ll") - n_params * F.ln(n) / (2 * n)).alias("m2"),
        (2 * valid - train).alias("m3"), F.when(F.col("v.k_active") > 0, valid / F.col("v.k_active")).alias("m4"), (valid - gap_weight * (train - valid)).alias("m5"), F.col("worst_season").alias("m6"),
    )
    ranks = [f"r{i}" for i in range(1, 7)]
    for i in range(1, 7):
        out = out.withColumn(f"r{i}", F.rank().over(Window.orderBy(F.desc_nulls_last(f"m{i}"))))  # one row a configuration
    return out.withColumn("mean_rank", sum(F.col(r) for r in ranks) / 6)


def marginal_gains(metrics: DataFrame) -> DataFrame:
    """(gamma, nc_from, nc_to, delta_ll, delta_k, gain) between neighbouring sizes of each gamma; gain is null where no state is added."""
    order = Window.partitionBy("gamma").orderBy("nc")
    step = metrics.withColumn("nc_to", F.lead("nc").over(order)).withColumn("delta_ll", F.lead("m1").over(order) - F.col("m1")).withColumn("delta_k", F.lead("k_valid").over(order) - F.col("k_valid"))
    return step.where("nc_to is not null").select("gamma", F.col("nc").alias("nc_from"), "nc_to", "delta_ll", "delta_k", F.when(F.col("delta_k") > 0, F.col("delta_ll") / F.col("delta_k")).alias("gain"))


def transfer_r2(rows: DataFrame) -> DataFrame:
    """(type, network, n, r2, r2_mean_corrected) of rows (type, network, x, recon): overall, by either and by both, null for all.

    r2 holds the residuals against the deviations from the training mean, which is 0 here; the corrected one against
    those from the rows' own mean. Null where nothing varies.
    """
    x, e = F.col("x"), F.col("x") - F.col("recon")
    sums = rows.cube("type", "network").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(x * x).alias("sst"), F.sum("x").alias("s"))
    own = F.col("sst") - F.col("s") * F.col("s") / F.col("n")
    share = lambda total: F.when(total > 1e-12, 1 - F.col("sse") / total)
    return sums.select("type", "network", "n", share(F.col("sst")).alias("r2"), share(own).alias("r2_mean_corrected"))


def delta_matrices(long: DataFrame, weights: DataFrame) -> DataFrame:
    """(state, i, j, delta): each state's matrix less the grand mean, weighted by (state, w)."""
    grand = long.join(weights, "state").groupBy("i", "j").agg((F.sum(F.col("c") * F.col("w")) / F.sum("w")).alias("g"))
    return long.join(grand, ["i", "j"]).select("state", "i", "j", (F.col("c") - F.col("g")).alias("delta"))


def block_means(long: DataFrame, value: str, per: int) -> DataFrame:
    """(state, a, b, mean): mean of a matrix's cells in each pair of groups of `per` neighbours."""
    group = lambda c: F.floor(F.col(c) / per).cast("int")
    return long.groupBy("state", group("i").alias("a"), group("j").alias("b")).agg(F.avg(value).alias("mean"))

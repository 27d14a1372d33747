"""Similarity of state vectors, overlap of occupancies and network composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.linear import covariances


def _pairs(long: DataFrame, item: str, dim: str, value: str) -> DataFrame:
    """Sums over the shared dimensions of every pair of items; one equi-join on the dimension."""
    a = long.select(F.col(item).alias("a"), dim, F.col(value).alias("x"))
    b = long.select(F.col(item).alias("b"), dim, F.col(value).alias("y"))
    joined = a.join(b, dim).where("a < b")
    return joined.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
    )


def pearson_pairs(long: DataFrame, item: str = "state", dim: str = "dim", value: str = "mean") -> DataFrame:
    """(a, b, r) for a < b; 0 where a vector does not vary; within -1..1."""
    s = _pairs(long, item, dim, value)
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    low = F.sqrt(F.greatest(F.lit(0.0), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * F.greatest(F.lit(0.0), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select("a", "b", F.when(low > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), top / low))).otherwise(0.0).alias("r"))


def cosine_pairs(long: DataFrame, item: str = "state", dim: str = "dim", value: str = "mean") -> DataFrame:
    s = _pairs(long, item, dim, value)
    low = F.sqrt(F.col("sxx") * F.col("syy"))
    return s.select("a", "b", F.when(low > 1e-12, F.col("sxy") / low).otherwise(0.0).alias("cosine"))


def combined_similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean of two similarities, each brought to 0..1 by (1 + r) / 2."""
    both = first.withColumnRenamed("r", "r1").join(second.withColumnRenamed("r", "r2"), ["a", "b"])
    return both.select("a", "b", (((1 + F.col("r1")) / 2 + (1 + F.col("r2")) / 2) / 2).alias("similarity"))


def nearest(pairs: DataFrame, score: str = "r") -> DataFrame:
    """Each item's best partner (the smaller one on ties) and how many chose that partner."""
    every = pairs.select("a", "b", score).union(pairs.select(F.col("b"), F.col("a"), F.col(score)))
    best = every.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(score), "b"))).where("k = 1")
    return best.withColumn("chosen_by", F.count(F.lit(1)).over(Window.partitionBy("b"))).select("a", "b", score, "chosen_by")


def occupancy_overlap(fo: DataFrame) -> DataFrame:
    """(a, b, overlap): sum of the smaller occupancies over sum of the larger ones, over runs."""
    there = fo.where("fo > 0").select("run", "state", "fo")
    total = there.groupBy("state").agg(F.sum("fo").alias("t"))
    b = there.select("run", F.col("state").alias("b"), F.col("fo").alias("y"))
    low = there.withColumnRenamed("state", "a").join(b, "run").where("a < b").groupBy("a", "b").agg(F.sum(F.least("fo", "y")).alias("low"))
    out = low.join(total.select(F.col("state").alias("a"), F.col("t").alias("ta")), "a").join(total.select(F.col("state").alias("b"), F.col("t").alias("tb")), "b")
    return out.select("a", "b", (F.col("low") / (F.col("ta") + F.col("tb") - F.col("low"))).alias("overlap"))


def run_jaccard(fo: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the sets of runs in which the states are active, for pairs that share a run."""
    there = fo.where(F.col("fo") > threshold).select("run", "state")
    size = there.groupBy("state").agg(F.count(F.lit(1)).alias("k"))
    both = there.withColumnRenamed("state", "a").join(there.withColumnRenamed("state", "b"), "run").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"))
    out = both.join(size.select(F.col("state").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("state").alias("b"), F.col("k").alias("kb")), "b")
    return out.select("a", "b", (F.col("i") / (F.col("ka") + F.col("kb") - F.col("i"))).alias("jaccard"))


def network_composition(means: DataFrame, per_network: int = 8) -> DataFrame:
    """(state, network, score, share): mean |loading| of each network and its share of the state's sum."""
    score = means.withColumn("network", F.floor(F.col("dim") / per_network).cast("int")).groupBy("state", "network").agg(F.avg(F.abs("mean")).alias("score"))
    return score.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("state")))


def participation(composition: DataFrame) -> DataFrame:
    """Per state: entropy of the shares by ln N, shares of the first and the first three networks, networks of a tenth or more."""
    k = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("share"), "network"))
    p = F.col("share")
    out = composition.withColumn("k", k).groupBy("state").agg(
        (-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0)) / F.ln(F.count(F.lit(1)))).alias("entropy"), F.sum(F.when(F.col("k") <= 1, p)).alias("top1"),
        F.sum(F.when(F.col("k") <= 3, p)).alias("top3"), F.sum((p >= 0.1).cast("int")).alias("n_tenth"), F.max(F.when(F.col("k") == 1, F.col("network"))).alias("dominant"),
    )
    return out


def gaussian_distances(params: DataFrame) -> DataFrame:
    """(a, b, bhattacharyya, mahalanobis) between diagonal Gaussians (state, dim, mean, var)."""
    a = params.select(F.col("state").alias("a"), "dim", F.col("mean").alias("ma"), F.col("var").alias("va"))
    b = params.select(F.col("state").alias("b"), "dim", F.col("mean").alias("mb"), F.col("var").alias("vb"))
    v = (F.col("va") + F.col("vb")) / 2
    gap = (F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")) / v
    return a.join(b, "dim").where("a < b").groupBy("a", "b").agg(
        F.sum(gap / 8 + F.ln(v / F.sqrt(F.col("va") * F.col("vb"))) / 2).alias("bhattacharyya"), F.sqrt(F.sum(gap)).alias("mahalanobis")
    )


def total_variation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Half the sum of |share - share| over the states of either side."""
    r = right.select("state", F.col("share").alias("other"))
    return left.select("state", "share").join(r, "state", "full").agg((F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))) / 2).alias("tv"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labellings (columns u, v)."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    n = labels.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"))
    cells = n.agg(two("k").alias("s"), F.sum("k").alias("n"))
    rows = n.groupBy("u").agg(F.sum("k").alias("k")).agg(two("k").alias("su"))
    cols = n.groupBy("v").agg(F.sum("k").alias("k")).agg(two("k").alias("sv"))
    every = cells.join(F.broadcast(rows)).join(F.broadcast(cols))  # one row each
    chance = F.col("su") * F.col("sv") / (F.col("n") * (F.col("n") - 1) / 2.0)
    low = (F.col("su") + F.col("sv")) / 2 - chance
    return every.select(F.when(low != 0, (F.col("s") - chance) / low).otherwise(1.0).alias("ari"))


def shrunk_correlations(rows: DataFrame, reliable: int = 30) -> DataFrame:
    """(state, i, j, r, shrinkage, n, reliable) for i <= j of rows (state, obs, dim, x): correlations of each state's
    covariance, drawn by Ledoit and Wolf's share towards equal variances.

    Two sums over rows serve, the products of two dimensions and the fourth power of each row's length; no state's rows
    meet in one task. Dimensions count from 0. A state of one row has the identity; reliable: it has `reliable` rows or more.
    """
    mean = rows.groupBy("state", "dim").agg(F.avg("x").alias("m"))
    centred = rows.join(mean, ["state", "dim"]).select("state", "obs", "dim", (F.col("x") - F.col("m")).alias("x"))
    whole = centred.groupBy("state", "obs").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"), F.sum(F.col("x") * F.col("x")).alias("s"))
    size = whole.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s") * F.col("s")).alias("fourth"), F.sum("s").alias("trace"), F.max(F.size("v")).alias("p"))
    # block products of whole rows; every row must have the same dimensions
    cov = covariances(whole.select("state", F.col("v.x").alias("x")), "state", "x", ddof=0)
    cov = cov.withColumn("state", F.col("state").cast(dict(rows.dtypes)["state"])).join(size, "state")
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    norm = cov.groupBy("state").agg(F.sum(F.col("c") * F.col("c") * twice).alias("square"))
    n, p, mu = F.col("n"), F.col("p"), F.col("trace") / F.col("n") / F.col("p")
    delta = (F.col("square") - p * mu * mu) / p
    beta = F.least(delta, (F.col("fourth") / n - F.col("square")) / (p * n))
    share = F.when(n < 2, 1.0).when(delta <= 1e-18, 0.0).otherwise(F.greatest(F.lit(0.0), beta) / delta)
    drawn = cov.join(norm, "state").withColumn("mu", mu).withColumn("shrinkage", share)
    drawn = drawn.withColumn("c", (1 - F.col("shrinkage")) * F.col("c") + F.when(F.col("i") == F.col("j"), F.col("shrinkage") * F.col("mu")).otherwise(0.0))
    own = drawn.where("i = j").select("state", F.col("i").alias("k"), F.col("c").alias("v"))
    both = drawn.join(own.select("state", F.col("k").alias("i"), F.col("v").alias("vi")), ["state", "i"]).join(own.select("state", F.col("k").alias("j"), F.col("v").alias("vj")), ["state", "j"])
    low = F.sqrt(F.col("vi") * F.col("vj"))
    r = F.when(F.col("i") == F.col("j"), 1.0).when(low > 1e-18, F.col("c") / low).otherwise(0.0)
    return both.select("state", "i", "j", r.alias("r"), "shrinkage", "n", (n >= reliable).alias("reliable"))

"""Transition counts and probabilities, n-grams, entropies and edge measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transition_counts(states: DataFrame) -> DataFrame:
    """(i, j, n) of neighbouring states within runs."""
    after = F.lead("state").over(Window.partitionBy("run").orderBy("tr"))
    return states.select(F.col("state").alias("i"), after.alias("j")).where("j is not null").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))


def change_probabilities(p: DataFrame, guard: float = 1e-12) -> DataFrame:
    """P(j | i) / (1 - P(i | i)) off the diagonal; 0 where the state never leaves."""
    stay = p.where("i = j").select("i", F.col("p").alias("stay"))
    leave = 1 - F.coalesce("stay", F.lit(0.0))
    return p.where("i <> j").join(stay, "i", "left").select("i", "j", F.when(leave > guard, F.col("p") / leave).otherwise(0.0).alias("p"))


def ngrams(changes: DataFrame, n: int) -> DataFrame:
    """(gram string, count) of `n` states in a row within runs of a change sequence."""
    by = Window.partitionBy("run").orderBy("pos")
    parts = [F.col("state")] + [F.lead("state", k).over(by) for k in range(1, n)]
    grams = changes.select("run", F.array(*parts).alias("g")).where(F.col("g")[n - 1].isNotNull())
    return grams.groupBy(F.array_join(F.transform("g", lambda s: s.cast("string")), ">").alias("gram")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run").alias("n_runs"))


def exit_counts(blocks: DataFrame) -> DataFrame:
    """(state, n_exits): blocks that another block of the run follows."""
    after = F.lead("state").over(Window.partitionBy("run").orderBy("block_index"))
    return blocks.withColumn("next", after).groupBy("state").agg(F.count("next").alias("n_exits"))


def reliable_states(states: DataFrame, blocks: DataFrame, least_trs: int = 30, least_exits: int = 20, excluded: DataFrame | None = None) -> DataFrame:
    """(state, n_trs, n_exits) of the states with enough TRs and exits that are not in `excluded` (state)."""
    if excluded is not None:
        states = states.join(excluded.select("state"), "state", "left_anti")
    trs = states.groupBy("state").agg(F.count(F.lit(1)).alias("n_trs"))
    return trs.join(exit_counts(blocks), "state").where((F.col("n_trs") >= least_trs) & (F.col("n_exits") >= least_exits))


def selectivity(p: DataFrame, states: DataFrame) -> DataFrame:
    """(state, first, p1, second, p2, concentration): every state's two likeliest exits (the larger one on ties) and their share of all exits.

    A state without exits has targets -1, probabilities and concentration 0; with one exit the second is -1 and 0.
    """
    exits = p.where("i <> j and p > 0")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("p"), F.desc("j")))
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    out = exits.withColumn("r", rank).groupBy(F.col("i").alias("state")).agg(pick("j", 1).alias("first"), pick("p", 1).alias("p1"), pick("j", 2).alias("second"), pick("p", 2).alias("p2"), F.sum("p").alias("all"))
    whole = states.select("state").distinct().join(out, "state", "left")
    filled = whole.fillna(-1, ["first", "second"]).fillna(0.0, ["p1", "p2", "all"])
    share = F.when(F.col("all") >= 1e-15, (F.col("p1") + F.col("p2")) / F.col("all")).otherwise(0.0)
    return filled.select("state", "first", "p1", "second", "p2", share.alias("concentration"))


def row_entropy(p: DataFrame) -> DataFrame:
    """Base-2 entropy of each state's row, with the probability to stay."""
    return p.groupBy("i").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.coalesce(F.max(F.when(F.col("i") == F.col("j"), F.col("p"))), F.lit(0.0)).alias("stay"))


def scaled_entropy(counts: DataFrame, keep: DataFrame) -> DataFrame:
    """Entropy by ln K of each kept state's row among the kept states."""
    inside = counts.join(keep.select(F.col("state").alias("i")), "i", "left_semi").join(keep.select(F.col("state").alias("j")), "j", "left_semi")
    size = keep.agg(F.count(F.lit(1)).alias("k"))
    p = probabilities(inside)
    return p.groupBy("i").agg(F.sum(-F.col("p") * F.ln("p")).alias("h")).join(F.broadcast(size)).select("i", F.when(F.col("k") > 1, F.col("h") / F.ln("k")).otherwise(0.0).alias("entropy"))


def asymmetry(p: DataFrame, n_states: int) -> DataFrame:
    """(p_ij - p_ji) / (p_ij + p_ji) for i < j where either direction is at least 1 / (n - 1)."""
    least = 1.0 / (n_states - 1)
    back = p.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("back"))
    both = p.select("i", "j", "p").join(back, ["i", "j"], "full").na.fill(0.0, ["p", "back"])
    kept = both.where((F.col("i") < F.col("j")) & ((F.col("p") >= least) | (F.col("back") >= least)))
    return kept.select("i", "j", ((F.col("p") - F.col("back")) / (F.col("p") + F.col("back"))).alias("asymmetry"))


def strengths(p: DataFrame, least: float = 0.01) -> DataFrame:
    """Degrees and strengths of the graph of edges with a probability of `least` or more."""
    edges = p.where((F.col("i") != F.col("j")) & (F.col("p") >= least))
    out = edges.groupBy(F.col("i").alias("state")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("p").alias("out_strength"))
    into = edges.groupBy(F.col("j").alias("state")).agg(F.count(F.lit(1)).alias("in_degree"), F.sum("p").alias("in_strength"))
    return out.join(into, "state", "full").na.fill(0)


def reciprocity(p: DataFrame, least: float = 0.01) -> DataFrame:
    edges = p.where((F.col("i") != F.col("j")) & (F.col("p") >= least)).select("i", "j")
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("b"))
    return edges.join(back, ["i", "j"], "left").agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.avg(F.coalesce("b", F.lit(0)).cast("double")), F.lit(0.0)).alias("reciprocity"))


def conditional_entropy(changes: DataFrame) -> DataFrame:
    """(order, entropy) in bits of the next state given one or two before, Miller-Madow corrected, contexts seen once left out."""
    by = Window.partitionBy("run").orderBy("pos")
    rows = changes.select("run", F.col("state").alias("c"), F.lag("state", 1).over(by).alias("b"), F.lag("state", 2).over(by).alias("a"))

    def one(order: int) -> DataFrame:
        context = ["b"] if order == 1 else ["a", "b"]
        pairs = rows.where(F.col(context[0]).isNotNull()).groupBy(*context, "c").agg(F.count(F.lit(1)).alias("n"))
        total = F.sum("n").over(Window.partitionBy(*context))
        p = F.col("n") / F.col("t")
        per = pairs.withColumn("t", total).where("t > 1").groupBy(*context, "t").agg((-F.sum(p * F.log2(p)) + (F.count(F.lit(1)) - 1) / (2 * F.col("t") * F.ln(F.lit(2.0)))).alias("h"))
        return per.agg((F.sum(F.col("t") * F.col("h")) / F.sum("t")).alias("entropy")).select(F.lit(order).alias("order"), "entropy")

    return one(1).union(one(2))


def preservation(changes: DataFrame, runs: DataFrame, n: int = 3, least_runs: int = 5) -> DataFrame:
    """Share of all `runs` in which a chain of `n` states stands, for the chains that stand in `least_runs` runs or more."""
    grams = ngrams(changes, n).where(F.col("n_runs") >= least_runs)
    every = runs.select("run").distinct().agg(F.count(F.lit(1)).alias("all_runs"))
    return grams.join(F.broadcast(every)).select("gram", "n", "n_runs", "all_runs", (F.col("n_runs") / F.col("all_runs")).alias("cps"))  # one row


def graph_edges(p: DataFrame, least: float = 0.01, strict: bool = False) -> DataFrame:
    """(i, j, p, w) off the diagonal with p at least (`strict`: above) `least`; w sums to 1 over each state's edges."""
    passes = F.col("p") > least if strict else F.col("p") >= least
    edges = p.where((F.col("i") != F.col("j")) & passes).select("i", "j", "p")
    return edges.withColumn("w", F.col("p") / F.sum("p").over(Window.partitionBy("i")))


def directed_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): share of the weight inside labels less what the out- and in-strengths of the labels give by chance."""
    of = labels.select("state", "label")
    w = edges.join(of.select(F.col("state").alias("i"), F.col("label").alias("a")), "i").join(of.select(F.col("state").alias("j"), F.col("label").alias("b")), "j")
    out = w.groupBy(F.col("a").alias("label")).agg(F.sum("p").alias("out"), F.sum(F.when(F.col("a") == F.col("b"), F.col("p")).otherwise(0.0)).alias("within"))
    into = w.groupBy(F.col("b").alias("label")).agg(F.sum("p").alias("into"))
    total = F.sum("out")
    both = out.join(into, "label", "full").na.fill(0.0)
    return both.agg((F.sum("within") / total - F.sum(F.col("out") * F.col("into")) / (total * total)).alias("q"))


def markov_order(changes: DataFrame, least: int = 10) -> DataFrame:
    """(order, log_likelihood, n_params, n_obs, bic, aic) of the first and of a restricted second order, on the same trigrams.

    The second order holds for contexts with `least` trigrams or more; the others fall back on the first.
    """
    by = Window.partitionBy("run").orderBy("pos")
    rows = changes.select(F.col("state").alias("a"), F.lead("state", 1).over(by).alias("b"), F.lead("state", 2).over(by).alias("c"))
    two = rows.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("a")))
    first = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.ln(F.col("n") / F.col("t")).alias("lp1"))
    three = rows.where("c is not null").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("a", "b")))
    both = three.join(first, ["b", "c"]).withColumn("rich", F.col("t") >= least)
    lp2 = F.when(F.col("rich"), F.ln(F.col("n") / F.col("t"))).otherwise(F.col("lp1"))
    free = two.groupBy("a").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.sum("k").alias("k1"))
    more = both.where("rich").groupBy("a", "b").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k2"))
    total = both.agg(F.sum(F.col("n") * F.col("lp1")).alias("l1"), F.sum(F.col("n") * lp2).alias("l2"), F.sum("n").alias("n_obs"))
    one = total.join(F.broadcast(free)).join(F.broadcast(more))  # one row each
    orders = F.array(F.struct(F.lit(1).alias("order"), F.col("l1").alias("log_likelihood"), F.col("k1").alias("n_params")), F.struct(F.lit(2).alias("order"), F.col("l2").alias("log_likelihood"), (F.col("k1") + F.col("k2")).alias("n_params")))
    each = one.select("n_obs", F.explode(orders).alias("o")).select("o.*", "n_obs")
    return each.withColumn("bic", -2 * F.col("log_likelihood") + F.col("n_params") * F.ln("n_obs")).withColumn("aic", -2 * F.col("log_likelihood") + 2 * F.col("n_params"))


def first_passage(p: DataFrame) -> DataFrame:
    """(i, j, steps): mean steps from state i to state j in the largest set of states that all reach each other, with the
    rows scaled to it. A table of at most a hundred states is solved on the driver; ties take the set of the smallest state.
    """
    rows = p.where("p > 0").select("i", "j", "p").collect()  # a row a pair of states
    states = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    place = {s: k for k, s in enumerate(states)}
    table = np.zeros((len(states), len(states)))
    for r in rows:
        table[place[r["i"]], place[r["j"]]] = r["p"]
    reach = (table > 0) | np.eye(len(states), dtype=bool)
    for _ in range(max(1, len(states).bit_length())):
        reach = (reach.astype(np.int64) @ reach.astype(np.int64)) > 0
    mutual = reach & reach.T
    best = int(mutual.sum(axis=1).argmax()) if states else 0
    kept = np.flatnonzero(mutual[best]) if states else np.zeros(0, int)
    inside = table[np.ix_(kept, kept)]
    total = inside.sum(axis=1, keepdims=True)
    inside = np.divide(inside, total, out=np.zeros_like(inside), where=total > 0)
    out = []
    for j in range(len(kept)):
        others = np.delete(np.arange(len(kept)), j)
        if len(others):
            steps = np.linalg.solve(np.eye(len(others)) - inside[np.ix_(others, others)], np.ones(len(others)))
            out += [(int(states[kept[i]]), int(states[kept[j]]), float(s)) for i, s in zip(others, steps)]
    return p.sparkSession.createDataFrame(out, "i int, j int, steps double")

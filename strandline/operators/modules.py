"""Modules of transition graphs: communities, consensus, null graphs and chains.

A graph of states has at most a few hundred nodes; what there are many of are graphs, seeds and draws. One unit of work is a
graph with one seed or draw, so units spread over tasks and nothing but a unit's edges meets in one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.draws import draw_hex
from strandline.operators.linear import least_squares
from strandline.sources.working import written


def _dense(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (ascending) and the weights between them; an edge with j = -1 only names a node."""
    nodes = np.unique(np.r_[edges["i"].to_numpy(), edges.loc[edges["j"] >= 0, "j"].to_numpy()])
    w = np.zeros((len(nodes), len(nodes)))
    own = edges[edges["j"] >= 0]
    np.add.at(w, (np.searchsorted(nodes, own["i"]), np.searchsorted(nodes, own["j"])), own["w"].to_numpy(float))
    return nodes, w


def modularity(w: np.ndarray, labels: np.ndarray, resolution: float = 1.0) -> float:
    """Directed weighted modularity; a symmetric matrix gives the undirected one. 0 without weight."""
    m = w.sum()
    if m <= 0:
        return 0.0
    member = (labels[:, None] == np.unique(labels)[None]).astype(float)
    inside = np.einsum("ic,ij,jc->c", member, w, member)
    return float((inside / m - resolution * (w.sum(axis=1) @ member) * (w.sum(axis=0) @ member) / m**2).sum())


def communities(w: np.ndarray, rng: np.random.Generator, resolution: float = 1.0) -> np.ndarray:
    """Labels by greedy moves of nodes in random order and by merging what they found, until nothing gains (Louvain)."""
    label = np.arange(len(w))
    m = w.sum()
    if m <= 0:
        return label
    level = w.astype(float)
    while True:
        n = len(level)
        out, into = level.sum(axis=1), level.sum(axis=0)
        own = np.arange(n)
        out_of, into_of = out.copy(), into.copy()
        both = level + level.T
        np.fill_diagonal(both, 0.0)
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in rng.permutation(n):
                out_of[own[i]] -= out[i]
                into_of[own[i]] -= into[i]
                gain = np.bincount(own, weights=both[i], minlength=n) / m - resolution * (out[i] * into_of + into[i] * out_of) / m**2
                best = int(gain.argmax())
                if gain[best] > gain[own[i]] + 1e-12:
                    own[i] = best
                    moved = moved_any = True
                out_of[own[i]] += out[i]
                into_of[own[i]] += into[i]
        if not moved_any:
            return label
        names, own = np.unique(own, return_inverse=True)
        label = own[label]
        if len(names) == n:
            return label
        member = np.eye(len(names))[own]
        level = member.T @ level @ member


def ordered_labels(labels: np.ndarray) -> np.ndarray:
    """Labels from 0 in the order of each module's first node."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def _per_unit(edges: DataFrame, keys: list[str], extra: DataFrame | None, f: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of each unit's edges; units are the values of `keys`, which `extra` (one column, few rows) multiplies."""
    units = edges if extra is None else edges.join(F.broadcast(extra))
    # units are small and slow, so their tasks must not be joined by their size
    units = units.repartition(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.sparkSession.sparkContext.defaultParallelism), *keys)
    return units.groupBy(*keys).applyInPandas(lambda key, part: f(tuple(int(k) for k in key), part), schema)


def community_runs(edges: DataFrame, n_seeds: int, seed: int = 0, resolution: float = 1.0) -> DataFrame:
    """(graph, seed, node, module, q): communities of every graph of edges (graph, i, j, w) for each of `n_seeds` orders of moves.

    Modules are numbered by their smallest node. A graph without weight has every node alone and q 0; rows with j = -1 name
    nodes without edges.
    """
    seeds = edges.sparkSession.range(n_seeds).select(F.col("id").cast("int").alias("seed"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _dense(part)
        label = ordered_labels(communities(w, np.random.default_rng([seed, *key]), resolution))
        return pd.DataFrame({"graph": key[0], "seed": key[1], "node": nodes, "module": label, "q": modularity(w, label, resolution)})

    return _per_unit(edges.select("graph", "i", "j", "w"), ["graph", "seed"], seeds, run, "graph long, seed int, node int, module int, q double")


def best_communities(runs: DataFrame) -> DataFrame:
    """(graph, node, module, q, share): each graph's run of highest q (the first of equals) and the share of runs that reach it."""
    of_run = runs.groupBy("graph", "seed").agg(F.first("q").alias("q"))
    best = of_run.groupBy("graph").agg(F.min_by("seed", F.struct(-F.round("q", 12), F.col("seed"))).alias("seed"), F.max("q").alias("top"))
    share = of_run.join(best.select("graph", "top"), "graph").groupBy("graph").agg(F.avg((F.col("q") >= F.col("top") - 1e-9).cast("double")).alias("share"))
    return runs.join(best.select("graph", "seed"), ["graph", "seed"]).join(share, "graph").select("graph", "node", "module", "q", "share")


def coassignment(runs: DataFrame) -> DataFrame:
    """(graph, i, j, w): share of runs that put two nodes (i <> j) in one module, where there is any.

    Pairs come from nodes of one module, which are states.
    """
    total = runs.groupBy("graph").agg(F.countDistinct("seed").alias("n"))
    a, b = runs.select("graph", "seed", "module", F.col("node").alias("i")), runs.select("graph", "seed", "module", F.col("node").alias("j"))
    pairs = a.join(b, ["graph", "seed", "module"]).where("i <> j").groupBy("graph", "i", "j").agg(F.count(F.lit(1)).alias("s"))
    return pairs.join(total, "graph").select("graph", "i", "j", (F.col("s") / F.col("n")).alias("w"))


def consensus(edges: DataFrame, n_runs: int, tau: float = 0.5, seed: int = 0, max_rounds: int = 20) -> DataFrame:
    """(graph, node, module, rounds, settled): communities of the coassignment graph, again and again, until all runs of a graph agree.

    Coassignments under `tau` count as none. A graph that still disagrees after `max_rounds` keeps its first run, not settled.
    """
    nodes = edges.select("graph", F.col("i").alias("node")).union(edges.where("j >= 0").select("graph", "j")).distinct()
    named = nodes.select("graph", F.col("node").alias("i"), F.lit(-1).alias("j"), F.lit(0.0).alias("w"))
    runs = written(community_runs(edges, n_runs, seed), "consensus")
    done, rounds = None, 0
    while True:
        rounds += 1
        again = coassignment(runs).where(F.col("w") >= tau).select("graph", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w").unionByName(named.join(runs.select("graph").distinct(), "graph", "left_semi"))
        runs = written(community_runs(again, n_runs, seed + rounds), "consensus")
        between = coassignment(runs).where("w < 1").select("graph").distinct()
        same = runs.where("seed = 0").join(between, "graph", "left_anti").select("graph", "node", "module", F.lit(rounds).alias("rounds"), F.lit(True).alias("settled"))
        done = same if done is None else done.unionByName(same)
        runs = runs.join(between, "graph", "left_semi")
        if rounds == max_rounds or runs.isEmpty():
            return done.unionByName(runs.where("seed = 0").select("graph", "node", "module", F.lit(rounds).alias("rounds"), F.lit(False).alias("settled")))


# null graphs


def rewired(present: np.ndarray, rng: np.random.Generator, swaps_per_edge: int = 10, tries_per_swap: int = 50) -> tuple[np.ndarray, int]:
    """A graph with the in-degrees, out-degrees and number of two-way pairs of `present`, by random swaps of ends; and swaps made.

    One-way edges swap among themselves, two-way pairs among themselves, and only to pairs of nodes without any edge.
    """
    a = present.copy()
    np.fill_diagonal(a, False)
    pools = {True: np.argwhere(np.triu(a & a.T, 1)).tolist(), False: np.argwhere(a & ~a.T).tolist()}
    rows = a.tolist()
    edges = int(a.sum())
    wanted, made = swaps_per_edge * edges, 0
    share = 2 * len(pools[True]) / max(edges, 1)
    if max(map(len, pools.values())) < 2:
        return a, 0
    draws: list[tuple[float, float, float, float]] = []
    for _ in range(tries_per_swap * wanted):
        if made >= wanted:
            break
        draws = draws or rng.random((4096, 4)).tolist()
        kind, first, second, turn = draws.pop()
        paired = len(pools[True]) >= 2 and (len(pools[False]) < 2 or kind < share)
        pool = pools[paired]
        x, y = int(first * len(pool)), int(second * (len(pool) - 1))
        y += y >= x
        (p, q), (r, s) = pool[x], pool[y]
        if paired and turn < 0.5:
            r, s = s, r
        if p == s or q == r or p == r or q == s or rows[p][s] or rows[s][p] or rows[r][q] or rows[q][r]:
            continue
        rows[p][q] = rows[r][s] = False
        rows[p][s] = rows[r][q] = True
        if paired:
            rows[q][p] = rows[s][r] = False
            rows[s][p] = rows[q][r] = True
        pool[x], pool[y] = [p, s], [r, q]
        made += 1
    return np.array(rows, bool).reshape(a.shape), made


def strength_matched(present: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The weights of w on the edges of `present`, so that strengths come out about as in w: at random turns the edge of
    some rank by what its ends still lack takes the weight of that rank."""
    left = np.sort(w[w > 0]).tolist()
    out, into = w.sum(axis=1), w.sum(axis=0)
    edges = np.argwhere(present)
    new, open_ = np.zeros(w.shape), np.arange(len(edges))
    while len(open_):
        need = np.maximum(out[edges[open_, 0]], 1e-12) * np.maximum(into[edges[open_, 1]], 1e-12)
        rank = int(rng.integers(len(open_)))
        at = open_[np.argsort(need, kind="stable")[rank]]
        i, j = edges[at]
        new[i, j] = left.pop(rank)
        out[i] -= new[i, j]
        into[j] -= new[i, j]
        open_ = open_[open_ != at]
    return new


def strength_error(new: np.ndarray, w: np.ndarray) -> float:
    """Mean relative gap of out- and in-strengths over the nodes that have any in w."""
    gaps = [np.abs(new.sum(axis=x) - w.sum(axis=x))[w.sum(axis=x) > 0] / w.sum(axis=x)[w.sum(axis=x) > 0] for x in (0, 1)]
    return float(np.concatenate(gaps).mean()) if sum(map(len, gaps)) else 0.0


def null_graphs(edges: DataFrame, n_draws: int, seed: int, weights: str = "matched") -> DataFrame:
    """(graph, draw from 1, i, j, w, swaps): rewired graphs with the observed weights, `matched` to strengths or `permuted` over the edges.

    Self-loops are left out. A graph with under two edges comes back as it is, without swaps.
    """
    if weights not in ("matched", "permuted"):
        raise ValueError("weights must be matched or permuted")
    draws = edges.sparkSession.range(1, n_draws + 1).select(F.col("id").cast("int").alias("draw"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *key])
        nodes, w = _dense(part)
        np.fill_diagonal(w, 0.0)
        a, swaps = rewired(w > 0, rng)
        if weights == "matched":
            new = strength_matched(a, w, rng)
        else:
            new = np.zeros(w.shape)
            new[a] = rng.permutation(w[w > 0])
        i, j = np.nonzero(new)
        return pd.DataFrame({"graph": key[0], "draw": key[1], "i": nodes[i], "j": nodes[j], "w": new[i, j], "swaps": swaps})

    return _per_unit(edges.select("graph", "i", "j", "w"), ["graph", "draw"], draws, run, "graph long, draw int, i int, j int, w double, swaps int")


def modularity_test(edges: DataFrame, n_draws: int, n_seeds: int, seed: int) -> DataFrame:
    """(graph, q, null_mean, null_sd, z, p, n_draws): best modularity against that of rewired, strength-matched graphs; p counts the observed one."""
    best = lambda runs, by: runs.groupBy(*by).agg(F.max("q").alias("q"))
    seen = best(community_runs(edges, n_seeds, seed), ["graph"])
    drawn = written(null_graphs(edges, n_draws, seed), "null-graphs")
    keyed = drawn.select((F.col("graph") * n_draws + F.col("draw") - 1).alias("graph"), "i", "j", "w")
    null = best(community_runs(keyed, n_seeds, seed), ["graph"]).select(F.floor(F.col("graph") / n_draws).alias("graph"), F.col("q").alias("nq"))
    both = null.join(seen, "graph").groupBy("graph", "q").agg(F.avg("nq").alias("null_mean"), F.stddev_pop("nq").alias("null_sd"), F.sum((F.col("nq") >= F.col("q") - 1e-12).cast("long")).alias("beyond"), F.count(F.lit(1)).alias("n_draws"))
    z = F.when(F.col("null_sd") > 0, (F.col("q") - F.col("null_mean")) / F.col("null_sd"))
    return both.select("graph", "q", "null_mean", "null_sd", z.alias("z"), ((F.col("beyond") + 1) / (F.col("n_draws") + 1)).alias("p"), "n_draws")


def row_shuffled(p: DataFrame, states: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(draw, i, j, p): every state's probabilities of other states (0 included) in an order by hash; out-strengths stay."""
    others = states.select(F.col("state").alias("i")).join(F.broadcast(states.select(F.col("state").alias("j"))), F.col("i") != F.col("j"))  # states by states
    held = others.join(p.select("i", "j", "p"), ["i", "j"], "left").select("i", "j", F.coalesce("p", F.lit(0.0)).alias("p"))
    drawn = held.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    place = drawn.withColumn("k", F.row_number().over(Window.partitionBy("draw", "i").orderBy("j")))
    dealt = drawn.select("draw", "i", "p", F.row_number().over(Window.partitionBy("draw", "i").orderBy(draw_hex(seed, "draw", "i", "j"), "j")).alias("k"))
    return place.select("draw", "i", "j", "k").join(dealt, ["draw", "i", "k"]).select("draw", "i", "j", "p")


def segment_shuffled(blocks: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(draw, i, j, n): transition counts after every run's blocks (run, block_index, state, duration_tr) change places by hash.

    Neighbours of one state run together, so their border counts as a stay; a draw has as many moves as the data.
    """
    drawn = blocks.select("run", "block_index", "state", "duration_tr").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    order = Window.partitionBy("draw", "run").orderBy(draw_hex(seed, "draw", "run", "block_index"), "block_index")
    moved = drawn.select("draw", F.col("state").alias("i"), F.lead("state").over(order).alias("j"), "duration_tr")
    across = moved.where("j is not null").groupBy("draw", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    inside = moved.groupBy("draw", "i").agg(F.sum(F.col("duration_tr") - 1).alias("n")).select("draw", "i", F.col("i").alias("j"), "n").where("n > 0")
    return across.unionByName(inside).groupBy("draw", "i", "j").agg(F.sum("n").alias("n"))


def nonmodular_chain(p: DataFrame) -> DataFrame:
    """(i, j, p): the chain with each state's own stay and targets by overall popularity, (1 - stay) q_j / (1 - q_i).

    q is a state's share of what enters from others; a stay is at most 1 - 1e-9. States are those with a row in p.
    """
    rows = p.groupBy("i").agg(F.sum("p").alias("row"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("p"))), F.lit(0.0)).alias("own"))
    stay = rows.select("i", F.least(F.greatest(F.col("own") / F.col("row"), F.lit(0.0)), F.lit(1 - 1e-9)).alias("stay"))
    into = p.where("i <> j").join(rows.select(F.col("i").alias("j")), "j", "left_semi").groupBy("j").agg(F.sum("p").alias("s"))
    q = into.join(F.broadcast(into.agg(F.sum("s").alias("t")))).select("j", (F.col("s") / F.col("t")).alias("q"))
    pairs = stay.join(q.select(F.col("j").alias("i"), F.col("q").alias("own_q")), "i", "left").join(F.broadcast(q))  # states by states
    other = pairs.where("i <> j").select("i", "j", ((1 - F.col("stay")) * F.col("q") / (1 - F.coalesce("own_q", F.lit(0.0)))).alias("p"))
    return other.unionByName(stay.select("i", F.col("i").alias("j"), F.col("stay").alias("p")))


def modular_chain(p: DataFrame, labels: DataFrame, ratio: float) -> DataFrame:
    """(i, j, p): moves within a module (labels: state, module) `ratio` times as likely against others, stays as they are."""
    here = labels.select(F.col("state").alias("i"), F.col("module").alias("a"))
    there = labels.select(F.col("state").alias("j"), F.col("module").alias("b"))
    off = p.where("i <> j").join(here, "i").join(there, "j").select("i", "j", (F.col("p") * F.when(F.col("a") == F.col("b"), ratio).otherwise(1.0)).alias("w"))
    stay = p.where("i = j").select("i", "j", "p")
    left = off.join(stay.select("i", F.col("p").alias("stay")), "i", "left").fillna(0.0, ["stay"])
    scaled = (1 - F.col("stay")) * F.col("w") / F.sum("w").over(Window.partitionBy("i"))
    return left.select("i", "j", scaled.alias("p")).unionByName(stay)


def betweenness(w: np.ndarray) -> np.ndarray:
    """Share of shortest paths between other nodes that pass each node, lengths 1 / w, scaled by (n - 1)(n - 2); ties split evenly."""
    n = len(w)
    score = np.zeros(n)
    length = np.where(w > 0, 1 / np.where(w > 0, w, 1.0), np.inf)
    for s in range(n):
        far, paths, done, order = np.full(n, np.inf), np.zeros(n), np.zeros(n, bool), []
        before: list[list[int]] = [[] for _ in range(n)]
        far[s], paths[s] = 0.0, 1.0
        while True:
            open_ = np.where(done, np.inf, far)
            v = int(open_.argmin())
            if not np.isfinite(open_[v]):
                break
            done[v] = True
            order.append(v)
            for t in np.flatnonzero(np.isfinite(length[v])):
                if t == v or done[t]:
                    continue
                d = far[v] + length[v, t]
                if d < far[t] * (1 - 1e-12):
                    far[t], paths[t], before[t] = d, paths[v], [v]
                elif d <= far[t] * (1 + 1e-12):
                    paths[t] += paths[v]
                    before[t].append(v)
        share = np.zeros(n)
        for t in reversed(order):
            for v in before[t]:
                share[v] += paths[v] / paths[t] * (1 + share[t])
            if t != s:
                score[t] += share[t]
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def node_betweenness(edges: DataFrame) -> DataFrame:
    """(graph, node, betweenness) of every graph of edges (graph, i, j, w); self-loops carry no path."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _dense(part)
        np.fill_diagonal(w, 0.0)
        return pd.DataFrame({"graph": key[0], "node": nodes, "betweenness": betweenness(w)})

    return _per_unit(edges.select("graph", "i", "j", "w"), ["graph"], None, run, "graph long, node int, betweenness double")


def merged_states(pairs: DataFrame, similarity: str, above: float, max_rounds: int = 60) -> DataFrame:
    """(state, merged): the smallest state that a chain of pairs (a, b) with a similarity over `above` leads to.

    Every round a state takes the smallest label of its neighbours and then that label's own label, so rounds grow with
    the logarithm of the longest chain; states without such a pair stay alone. Null and NaN similarities link nothing.
    """
    states = pairs.select(F.col("a").alias("state")).union(pairs.select("b")).distinct()
    x = F.col(similarity)
    near = pairs.where(~F.isnan(x) & (x > above)).select("a", "b")
    links = written(near.union(near.select("b", "a")).distinct(), "merge-links")
    labels = states.select("state", F.col("state").alias("merged"))
    for _ in range(max_rounds):
        offer = links.join(labels.withColumnRenamed("state", "b"), "b").groupBy(F.col("a").alias("state")).agg(F.min("merged").alias("offer"))
        taken = labels.join(offer, "state", "left").select("state", F.least("merged", "offer").alias("merged"), F.col("merged").alias("old"))
        jumped = taken.alias("t").join(taken.select(F.col("state").alias("merged"), F.col("merged").alias("further")), "merged").select("state", F.least("merged", "further").alias("merged"), "old")
        labels = written(jumped, "merge-labels")
        if labels.where("merged <> old").isEmpty():
            return labels.select("state", "merged")
        labels = labels.select("state", "merged")
    raise RuntimeError("labels did not settle")


def reciprocity(edges: DataFrame) -> Column | DataFrame:
    """(graph, reciprocity): share of edges whose opposite is there too; self-loops left out."""
    one = edges.where("i <> j").select("graph", "i", "j").distinct()
    back = one.select("graph", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("back"))
    return one.join(back, ["graph", "i", "j"], "left").groupBy("graph").agg(F.avg(F.coalesce("back", F.lit(0.0))).alias("reciprocity"))


def predicted_weights(p: DataFrame, dyads: DataFrame, predictors: list[str]) -> DataFrame:
    """(i, j, predicted, residual): log probability of every move to another state, by regression on the logs of the states'
    strengths out and in and on `predictors` of `dyads` (i, j, ...).

    Moves that do not occur have no residual, but a prediction where all predictors are there. Strengths are sums over
    other states; a strength of 0 counts as 1e-12.
    """
    off = p.where("i <> j and p > 0").select("i", "j", "p")
    out = off.groupBy("i").agg(F.ln(F.greatest(F.sum("p"), F.lit(1e-12))).alias("_out"))
    into = off.groupBy("j").agg(F.ln(F.greatest(F.sum("p"), F.lit(1e-12))).alias("_in"))
    low = F.ln(F.lit(1e-12))
    whole = dyads.where("i <> j").select("i", "j", *predictors).join(out, "i", "left").join(into, "j", "left").join(off, ["i", "j"], "left")
    whole = whole.select("i", "j", F.lit(0).alias("_g"), F.ln("p").alias("_y"), F.coalesce("_out", low).alias("_out"), F.coalesce("_in", low).alias("_in"), *[F.col(c).cast("double").alias(c) for c in predictors])
    xs = ["_out", "_in", *predictors]
    fit = least_squares(whole, "_y", xs, ["_g"]).select("_g", "b")
    line: Column = F.col("b")[0]
    for k, c in enumerate(xs, 1):
        line = line + F.col("b")[k] * F.col(c)
    return whole.join(F.broadcast(fit), "_g").select("i", "j", line.alias("predicted"), (F.col("_y") - line).alias("residual")).where("predicted is not null")


def predicted_null_graphs(predicted: DataFrame, n_draws: int, seed: int, least: float = 0.01) -> DataFrame:
    """(draw, i, j, w) with w = exp(prediction + a residual) of at least `least`.

    The pairs stand in an order by hash and take the residuals, which stand in the order of their own pairs, one after the other
    and from the front again where there are fewer residuals than pairs. Pairs are states by states.
    """
    drawn = F.explode(F.sequence(F.lit(1), F.lit(n_draws))).alias("draw")
    order = Window.partitionBy("draw").orderBy(draw_hex(seed, "draw", "i", "j"), "i", "j")
    pairs = predicted.select("i", "j", "predicted", drawn).withColumn("_k", F.row_number().over(order) - 1)
    held = predicted.where("residual is not null").select("i", "j", "residual")
    size = held.agg(F.count(F.lit(1)).alias("_n"))
    lined = held.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("i", "j")) - 1).select("_k", "residual")
    dealt = pairs.join(F.broadcast(size)).withColumn("_k", F.col("_k") % F.col("_n")).join(lined, "_k")
    return dealt.select("draw", "i", "j", F.exp(F.col("predicted") + F.col("residual")).alias("w")).where(F.col("w") >= least)

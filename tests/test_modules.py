"""Graph modules and null graphs: invariants, planted modules, small graphs by enumeration; nulls against plain loops."""

import itertools
from collections import Counter
from math import comb

import numpy as np
import pytest

from strandline.operators import modules as G
from strandline.operators import nulls as N


def random_graph(seed=0, n=30, share=0.2, two_way=0.5):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n)) < share
    back = np.triu(rng.random((n, n)) < two_way, 1) & (a | a.T)
    a = (a | back | back.T) & ~np.eye(n, dtype=bool)
    return np.where(a, rng.lognormal(-4, 1, (n, n)), 0.0)


def planted(seed=1, n=40, k=4):
    rng = np.random.default_rng(seed)
    label = np.repeat(np.arange(k), n // k)
    a = (rng.random((n, n)) < np.where(label[:, None] == label, 0.5, 0.05)) & ~np.eye(n, dtype=bool)
    return np.where(a, rng.lognormal(-4, 0.5, (n, n)), 0.0), label


def frame(spark, graphs):
    return spark.createDataFrame([(g, int(i), int(j), float(w[i, j])) for g, w in graphs.items() for i, j in zip(*np.nonzero(w))], "graph long, i int, j int, w double")


def test_modularity_by_definition():
    w, label = planted()
    m, out, into = w.sum(), w.sum(axis=1), w.sum(axis=0)
    q = sum(w[i, j] / m - out[i] * into[j] / m**2 for i in range(40) for j in range(40) if label[i] == label[j])
    assert abs(G.modularity(w, label) - q) < 1e-12 and G.modularity(np.zeros((3, 3)), np.arange(3)) == 0


def test_communities_find_planted_modules(spark):
    w, label = planted()
    runs = G.community_runs(frame(spark, {1: w, 2: w.T.copy()}), 6)
    best = G.best_communities(runs).collect()
    again = G.best_communities(G.community_runs(frame(spark, {1: w, 2: w.T.copy()}), 6)).collect()
    assert sorted(map(tuple, best)) == sorted(map(tuple, again))
    own = {r.node: r.module for r in best if r.graph == 1}
    assert [own[i] for i in range(40)] == label.tolist() and all(r.q >= G.modularity(w, label) - 1e-9 and 0 < r.share <= 1 for r in best if r.graph == 1)


def test_best_of_small_graphs_by_enumeration():
    for seed in range(4):
        w = random_graph(seed, 6, 0.4)
        best = max(G.modularity(w, np.array(p)) for p in itertools.product(range(6), repeat=6) if all(x <= max(p[:i], default=-1) + 1 for i, x in enumerate(p)))
        found = max(G.modularity(w, G.communities(w, np.random.default_rng(s))) for s in range(30))
        assert found <= best + 1e-12 and found > best - 0.02


def test_graph_without_weight(spark):
    nodes = spark.createDataFrame([(1, 0, -1, 0.0), (1, 5, -1, 0.0)], "graph long, i int, j int, w double")
    got = G.best_communities(G.community_runs(nodes, 2)).collect()
    assert {(r.node, r.module, r.q) for r in got} == {(0, 0, 0.0), (5, 1, 0.0)}


def test_rewiring_keeps_degrees_and_two_way_edges():
    w = random_graph()
    a = w > 0
    new, swaps = G.rewired(a, np.random.default_rng(3))
    assert swaps > 5 * a.sum() and (new.sum(0) == a.sum(0)).all() and (new.sum(1) == a.sum(1)).all()
    assert (new & new.T).sum() == (a & a.T).sum() and not new.diagonal().any() and (new != a).any()
    weights = G.strength_matched(new, w, np.random.default_rng(3))
    assert np.allclose(np.sort(weights[new]), np.sort(w[a])) and G.strength_error(weights, w) < 0.6
    shuffled = np.zeros(w.shape)
    shuffled[new] = np.random.default_rng(1).permutation(w[a])
    assert G.strength_error(weights, w) < G.strength_error(shuffled, w)
    assert G.rewired(np.zeros((4, 4), bool), np.random.default_rng(0))[1] == 0


def test_modularity_test_tells_planted_from_random(spark):
    got = {r.graph: r for r in G.modularity_test(frame(spark, {1: planted()[0], 2: random_graph(5)}), 9, 3, 7).collect()}
    assert got[1].p == 0.1 and got[1].q > got[1].null_mean + 0.1 and got[1].n_draws == 9 and got[2].q < got[2].null_mean + 0.1


def test_consensus(spark):
    w, label = planted()
    lone = w.copy()
    lone[39], lone[:, 39] = 0, 0
    edges = frame(spark, {1: w, 2: lone}).union(spark.createDataFrame([(2, 39, -1, 0.0)], "graph long, i int, j int, w double"))
    got = G.consensus(edges, 4).collect()
    assert [r.module for r in sorted(got, key=lambda r: r.node) if r.graph == 1] == label.tolist() and all(r.settled for r in got)
    assert sum(r.graph == 2 for r in got) == 40


def test_segment_shuffle_counts_rebuilt_sequences(spark):
    rng = np.random.default_rng(0)
    runs = {r: np.repeat(rng.integers(0, 6, 40), rng.integers(1, 6, 40)) for r in range(5)}
    blocks, seen = [], Counter()
    for r, seq in runs.items():
        cut = np.r_[0, np.flatnonzero(np.diff(seq)) + 1, len(seq)]
        blocks += [(r, k, int(seq[a]), int(b - a)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
        seen.update(zip(seq[:-1].tolist(), seq[1:].tolist()))
    got = G.segment_shuffled(spark.createDataFrame(blocks, "run long, block_index long, state int, duration_tr int"), 3, 1).collect()
    size = Counter(int(s) for seq in runs.values() for s in seq)
    for draw in (1, 2, 3):
        own = {(r.i, r.j): r.n for r in got if r.draw == draw}
        rows = Counter()
        for (i, _), n in own.items():
            rows[i] += n
        assert sum(own.values()) == sum(seen.values()) and own != dict(seen) and all(size[s] - 5 <= rows[s] <= size[s] for s in size)


def brute_betweenness(w):
    n = len(w)
    out = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        paths = []
        for k in range(n - 1):
            for mid in itertools.permutations([v for v in range(n) if v not in (s, t)], k):
                way = [s, *mid, t]
                if all(w[a, b] > 0 for a, b in zip(way, way[1:])):
                    paths.append((sum(1 / w[a, b] for a, b in zip(way, way[1:])), mid))
        if paths:
            short = [m for length, m in paths if length <= min(p[0] for p in paths) * (1 + 1e-9)]
            for m in short:
                for v in m:
                    out[v] += 1 / len(short)
    return out / ((n - 1) * (n - 2))


def test_betweenness(spark):
    rng = np.random.default_rng(2)
    graphs = {g: np.where((rng.random((6, 6)) < 0.5) & ~np.eye(6, dtype=bool), rng.integers(1, 4, (6, 6)) / 4, 0.0) for g in range(4)}
    got = G.node_betweenness(frame(spark, graphs)).collect()
    for r in got:
        assert abs(r.betweenness - brute_betweenness(graphs[r.graph])[r.node]) < 1e-9


def test_merged_states_follow_chains(spark):
    pairs = [(i, i + 1, 0.95) for i in range(0, 40)] + [(50, 51, 0.95), (51, 52, 0.1), (52, 60, None), (60, 61, float("nan"))]
    got = {r.state: r.merged for r in G.merged_states(spark.createDataFrame(pairs, "a int, b int, r double"), "r", 0.9).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[51] == 50 and got[52] == 52 and got[60] == 60 and got[61] == 61


# nulls


def test_unranked():
    assert [tuple(np.flatnonzero(r)) for r in N.unranked(np.arange(comb(7, 3)), 7, 3)] == list(itertools.combinations(range(7), 3))


def test_session_null_by_enumeration(spark):
    rng = np.random.default_rng(4)
    runs = [(r, r % 7, r % 7 in (1, 4)) for r in range(30)]
    fo = rng.dirichlet(np.ones(3), 30) + np.array([[0.3, 0, 0]]) * np.array([a for *_, a in runs])[:, None]
    rows = [(r, s, float(fo[r, s])) for r in range(30) for s in range(3)]
    got = N.session_null(spark.createDataFrame(rows, "run long, state int, fo double"), spark.createDataFrame(runs, "run long, unit int, a boolean")).first()
    l1 = lambda units: np.abs(fo[[r for r in range(30) if r % 7 in units]].mean(axis=0) - fo[[r for r in range(30) if r % 7 not in units]].mean(axis=0)).sum()
    every = [l1(c) for c in itertools.combinations(range(7), 2)]
    assert abs(got.l1 - l1((1, 4))) < 1e-12 and got.n_assignments == 21 and abs(got.p - np.mean([v >= l1((1, 4)) - 1e-12 for v in every])) < 1e-12
    only = spark.createDataFrame([(r, u, True) for r, u, _ in runs], "run long, unit int, a boolean")
    assert N.session_null(spark.createDataFrame(rows, "run long, state int, fo double"), only).first().p is None
    with pytest.raises(ValueError):
        N.session_null(spark.createDataFrame(rows, "run long, state int, fo double"), spark.createDataFrame([(0, 0, True), (1, 0, False)], "run long, unit int, a boolean"))


def test_binomial_tail_and_contexts(spark):
    for n in range(1, 12):
        for k in range(n + 1):
            for p in (0.01, 0.3, 0.9, 1.0):
                assert abs(N._binomial_upper(n, k, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))) < 1e-12
    assert N._binomial_upper(100_000, 50_500, 0.5) < 1e-2 and N._binomial_upper(100_000, 10, 0.5) == 1.0
    seq = [(r, p, s) for r in range(20) for p, s in enumerate([0, 1, 2, 3, 1, 0, 4, 1, 2 if r % 4 == 0 else 0])]
    got = {(r.a, r.b, r.c): r for r in N.context_test(spark.createDataFrame(seq, "run long, pos long, state int"), 10).collect()}
    assert got[0, 1, 2].n_c == 20 and got[0, 1, 2].p_context == 1 and got[0, 1, 2].p_other == 5 / 40 and got[0, 1, 2].p < 1e-9 and got[3, 1, 0].p_other == 15 / 40


def test_excess_returns(spark):
    """Returns beyond the neighbours of each run are found, a state whose neighbours only differ between runs is not."""
    rng = np.random.default_rng(5)
    visits = [(1, i % 10, i, a, a if rng.random() < 0.8 else b) for i, (a, b) in enumerate(zip(rng.integers(0, 4, 200).tolist(), rng.integers(0, 4, 200).tolist()))]
    visits += [(2, i % 10, i, 10 + i % 10, 10 + i % 10) for i in range(100)] + [(3, 1, 1, 0, 0)]
    visits += [(4, i % 5, i, a, b) for i, (a, b) in enumerate(zip(rng.integers(0, 3, 100).tolist(), rng.integers(0, 3, 100).tolist()))]
    got = {r.state: r for r in N.excess_returns(spark.createDataFrame(visits, "state int, run long, visit long, a int, b int"), 99, 1).collect()}
    assert set(got) == {1, 4} and got[1].p == 0.01 and got[1].share > got[1].expected + 0.3 and got[4].p > 0.02
    expected = 0.0
    for run in range(10):
        own = [(a, b) for s, r, _, a, b in visits if s == 1 and r == run]
        expected += sum(n * Counter(b for _, b in own)[x] for x, n in Counter(a for a, _ in own).items()) / len(own)
    assert abs(got[1].expected - expected / 200) < 1e-12


def dense_loss(ratio, y, x, session):
    """Restricted likelihood (times -2, up to a constant) by whole matrices."""
    z = (session[:, None] == np.unique(session)[None]).astype(float)
    v = np.eye(len(y)) + ratio * z @ z.T
    design = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(v)
    info = design.T @ inv @ design
    beta = np.linalg.solve(info, design.T @ inv @ y)
    rest = y - design @ beta
    s2 = rest @ inv @ rest / (len(y) - 2)
    return (len(y) - 2) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(info)[1], beta[1], s2, np.sqrt(s2 * np.linalg.inv(info)[1, 1])


def test_random_intercepts_have_the_highest_likelihood(spark):
    rng = np.random.default_rng(6)
    session = np.repeat(np.arange(8), [3, 4, 5, 3, 6, 4, 3, 2])
    at = np.concatenate([np.arange(n) for n in np.bincount(session)])
    level = rng.normal(size=8) * 0.5
    y = {1: level[session] + 0.2 * at + rng.normal(size=30) * 0.3, 2: rng.normal(size=30), 3: np.full(30, 0.4)}
    fo = spark.createDataFrame([(r, s, float(v[r])) for s, v in y.items() for r in range(30)], "run long, state int, fo double")
    runs = spark.createDataFrame([(r, int(session[r]), int(at[r])) for r in range(30)], "run long, session long, at long")
    got = {r.state: r for r in N.random_intercepts(fo, runs).collect()}
    keep = session < 7
    x = np.concatenate([np.arange(n) - (n - 1) / 2 for n in np.bincount(session)[:7]])
    for s in (1, 2):
        ratio = got[s].icc / (1 - got[s].icc)
        loss, slope, s2, se = dense_loss(ratio, y[s][keep], x, session[keep])
        assert abs(got[s].slope - slope) < 1e-9 and abs(got[s].residual_variance - s2) < 1e-9 and abs(got[s].se - se) < 1e-9 and got[s].n == 28 and got[s].n_sessions == 7
        assert all(loss <= dense_loss(r, y[s][keep], x, session[keep])[0] + 1e-7 for r in [0, ratio * 0.9, ratio * 1.1, 0.1, 1, 10])
    assert got[3].slope is None and got[3].n == 28
    slopes = {r.state: r for r in N.session_slopes(fo, runs, 99, 1).collect()}
    assert abs(slopes[1].slope - got[1].slope) < 1e-12 and slopes[1].p <= 0.03 and slopes[2].p > 0.02 and slopes[3].p == 1.0


def test_surrogates_follow_their_chain(spark):
    seq = [(r, p, (p + r) % 3) for r in range(40) for p in range(12)]
    changes = spark.createDataFrame(seq + [(99, 0, 7)], "run long, pos long, state int")
    rows = N.change_rows(changes)
    drawn = N.surrogate_chains(changes, rows, 2, 5).collect()
    assert len(drawn) == 2 * (480 + 1) and {(r.run, r.pos, r.state) for r in drawn if r.run < 99} == set(seq)  # a sure chain comes out as it is
    test = N.chain_test(changes, 2, 5, 4, 1).collect()
    assert {r.gram: (r.n_runs, r.p, r.null_mean) for r in test} == {g: (40, 1.0, 40 / 41) for g in ("0>1", "1>2", "2>0")}


def test_dyads(spark):
    rng = np.random.default_rng(7)
    n = 9
    x, z = rng.normal(size=(n, n)), rng.normal(size=(n, n))
    rows = [(i, j, float(2 * x[i, j] - z[i, j] + 0.01 * rng.normal()), float(x[i, j]), float(z[i, j]), float(rng.normal())) for i in range(n) for j in range(i + 1, n)]
    df = spark.createDataFrame(rows, "i int, j int, y double, x double, z double, noise double")
    got = {r.predictor: r for r in N.dyadic_regression(df, "y", ["x", "z", "noise"], 19, 3).collect()}
    y, design = np.array([r[2] for r in rows]), np.column_stack([np.ones(36), [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rest = y - design @ beta
    t = beta / np.sqrt(rest @ rest / 32 * np.diag(np.linalg.inv(design.T @ design)))
    for k, name in enumerate(("x", "z", "noise"), 1):
        assert abs(got[name].b - beta[k]) < 1e-8 and abs(got[name].t - t[k]) < 1e-5 * (1 + abs(t[k]))
    assert got["x"].p == got["z"].p == 0.05 and got["noise"].p > 0.05
    m = N.mantel(df, "y", "x", 19, 3).first()
    assert abs(m.r - np.corrcoef(y, design[:, 1])[0, 1]) < 1e-9 and m.p == 0.05 and m.n == 36

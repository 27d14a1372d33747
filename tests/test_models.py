"""Decoding and assignment against plain enumeration, and the rules of states on hand-made cases."""

import itertools
import math

import numpy as np
import pytest

from strandline.operators import blocks, decoding, matching, occupancy, stats, taxonomy, transitions


def small_model(k=3, d=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.random((k, k)) + 0.1
    start = rng.random(k)
    return decoding.GaussianModel(start / start.sum(), rows / rows.sum(axis=1, keepdims=True), rng.normal(size=(k, d)), rng.random((k, d)) + 0.5)


@pytest.mark.parametrize("seed", range(4))
def test_paths(seed):
    model, rng = small_model(seed=seed), np.random.default_rng(seed + 50)
    x = rng.normal(size=(6, 2))
    density = model.log_density(x)
    scores = {}
    for path in itertools.product(range(3), repeat=6):
        p = math.log(model.start[path[0]]) + density[0, path[0]]
        scores[path] = p + sum(math.log(model.transitions[a, b]) + density[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))
    best = max(scores, key=scores.get)
    path, score = decoding.best_path(model, x)
    assert tuple(path) == best and score == pytest.approx(scores[best], abs=1e-6)
    total = np.logaddexp.reduce(list(scores.values()))
    p, loglik = decoding.posteriors(model, x)
    want = np.array([[sum(math.exp(s - total) for q, s in scores.items() if q[t] == k) for k in range(3)] for t in range(6)])
    assert loglik == pytest.approx(total) and np.allclose(p, want)


def test_decoded_runs(spark):
    model, rng = small_model(), np.random.default_rng(3)
    runs = {r: rng.normal(size=(n, 2)) for r, n in ((1, 9), (2, 1), (3, 4))}
    rows = spark.createDataFrame([(r, t, v.tolist()) for r, x in runs.items() for t, v in enumerate(x)], "run long, tr int, features array<double>")
    got = {(r["run"], r["tr"]): (r["state"], r["log_prob"]) for r in decoding.decoded(rows, model).collect()}
    for r, x in runs.items():
        path, score = decoding.best_path(model, x)
        assert [got[r, t] for t in range(len(x))] == [(k, pytest.approx(score)) for k in path]
    kept = {r["state"] for r in decoding.decoded(rows, model, {0: 0.5, 2: 0.5, 1: 0.001}, 0.01).collect()}
    assert kept <= {0, 2}
    probs = decoding.scored(rows, model).collect()
    assert len(probs) == 14 and all(sum(r["probabilities"]) == pytest.approx(1) for r in probs)
    assert decoding.decoded(rows.limit(0), model).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (4, 4), (6, 6)])
def test_assign(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.integers(0, 9, shape).astype(float) - 3
        i, j = matching.assign(cost)
        assert len(set(i)) == len(i) == min(shape) == len(set(j)) and list(i) == sorted(i)
        small, large = sorted(shape)
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[r, q] for r, q in enumerate(p)) for p in itertools.permutations(range(large), small))
        assert cost[i, j].sum() == pytest.approx(best)


def test_matched(spark):
    rows = [("x", 1, 10, 0.9), ("x", 1, 11, 0.8), ("x", 2, 10, 0.85), ("x", 2, 11, 0.1), ("y", 5, 7, 0.2)]
    got = matching.matched(spark.createDataFrame(rows, "pair string, a int, b int, r double"), "pair").collect()
    assert sorted(map(tuple, got)) == [("x", 1, 11, 0.8, True), ("x", 2, 10, 0.85, True), ("y", 5, 7, 0.2, False)]


def table(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_taxonomy_rules(spark):
    """Each category by hand, in order of priority; missing and NaN q-values are not met."""
    n = float("nan")
    rec = table(spark, [(0, 0.0), (1, 0.5), (2, 0.5), (3, 0.5), (4, 0.5), (5, 0.5), (6, 0.5), (7, 0.05), (8, 0.1), (9, 0.5)], "state int, recurrence double")
    dwell = table(spark, [(0, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False), (8, False)], "state int, sub_hrf boolean")
    anchors = taxonomy.anchoring(table(spark, [(1, 0.0), (2, 0.05), (3, 0.09), (4, 0.5), (5, n)], "state int, q double"), table(spark, [(2, 0.05), (3, 0.1), (4, 0.01), (9, n)], "state int, q double"))
    assert {r["state"]: r["anchoring"] for r in anchors.collect()} == {1: "a_start_specific", 2: "ab_start_common", 3: "a_start_specific", 4: "b_start_specific", 5: "none", 9: "none"}
    season = table(spark, [(5, 0.01), (6, 0.01), (8, 0.05)], "state int, q double")
    trend = table(spark, [(5, 0.04), (6, n), (8, 0.01)], "state int, q double")
    slopes = table(spark, [(5, -0.1, 0.01), (6, 0.1, 0.01), (7, 0.1, n), (8, -0.1, 0.2)], "state int, slope double, q double")
    tags = {r["state"]: (r["session_trend_down"], r["session_trend_up"]) for r in taxonomy.flags(dwell, rec, season, trend, anchors, slopes).collect()}
    assert tags[5] == (True, False) and tags[6] == (False, True) and not any(any(tags[s]) for s in (0, 7, 8, 9))
    got = {r["state"]: r["summary_category"] for r in taxonomy.categories(taxonomy.flags(dwell, rec, season, trend, anchors, slopes)).collect()}
    on, fit = "run_onset_anchored", "eligible_for_content_analysis"
    assert got == {0: "unused", 1: "low_confidence", 2: on, 3: on, 4: on, 5: "season_temporal", 6: fit, 7: "rare", 8: fit, 9: fit}


def test_sessions_rule(spark):
    """All runs of a subject in time order, numbered from 0; a gap of exactly the bound opens none."""
    rows = table(spark, [(1, "p", 0.0), (2, "p", 7.0), (3, "p", 14.1), (4, "q", 5.0), (5, "p", 14.0)], "run long, subject string, acq_time double")
    got = {r["run"]: r["session"] for r in occupancy.sessions(rows).collect()}
    assert got == {1: 0, 2: 0, 5: 0, 3: 0, 4: 0}
    got = {r["run"]: r["session"] for r in occupancy.sessions(rows, 6.9).collect()}
    assert got == {1: 0, 2: 1, 5: 2, 3: 2, 4: 0}


def test_low_confidence_and_fdr(spark):
    few = occupancy.low_confidence(table(spark, [(1, t, 0 if t < 9 else 1) for t in range(19)], "run long, tr int, state int"))
    assert [tuple(r) for r in few.collect()] == [(0, 9)]
    p = table(spark, [(0, 0.01), (1, 0.04), (2, 0.03), (3, None), (4, float("nan")), (5, 1.0)], "state int, p double")
    got = {r["state"]: r["q"] for r in stats.bh_fdr(p).collect()}
    assert got == {0: pytest.approx(0.04), 1: pytest.approx(0.04 * 4 / 3), 2: pytest.approx(0.04 * 4 / 3), 3: 1.0, 4: 1.0, 5: 1.0}
    assert [r["q"] for r in stats.bh_fdr(p.where("p is null")).collect()] == [None]


def test_chains_over_all_runs(spark):
    """Preservation counts all runs, also those without the chain's first state and those whose sequence is empty."""
    rows = [(r, t, s) for r in range(4) for t, s in enumerate([1, 1, 2, 2, 3])] + [(4, t, s) for t, s in enumerate([3, 3, 1, 1])] + [(5, 0, 1)]
    states = table(spark, rows, "run long, tr int, state int")
    changes = blocks.change_sequence(blocks.state_blocks(states))
    assert {(r["run"], r["state"]) for r in changes.collect()} == {*((r, s) for r in range(4) for s in (1, 2)), (4, 3), (4, 1)}
    got = transitions.preservation(changes, states, 2, 4).collect()
    assert [(r["gram"], r["n_runs"], r["all_runs"], r["cps"]) for r in got] == [("1>2", 4, 6, pytest.approx(4 / 6))]


def test_flicker_rule(spark):
    seq = [1, 1, 2, 1, 3, 1, 1] + [4] * 5 + [1, 2, 1, 2, 2]
    states = table(spark, [(1, t, s) for t, s in enumerate(seq)] + [(2, 0, 5)], "run long, tr int, state int")
    got = {(r["run"], r["tr"]): r["state"] for r in blocks.collapse_flicker(states).collect()}
    assert [got[1, t] for t in range(len(seq))] == [1] * 7 + [4] * 5 + [1, 1, 1, 2, 2] and got[2, 0] == 5


def test_modularity_of_two_blocks(spark):
    edges = table(spark, [(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "i int, j int, p double")
    labels = table(spark, [(0, 0), (1, 0), (2, 1), (3, 1)], "state int, label int")
    assert transitions.directed_modularity(edges, labels).first()["q"] == pytest.approx(0.5)


def test_first_passage(spark):
    """Against the expected steps of a walk, by long sums; states outside the largest set are left out."""
    rows = [(0, 0, 0.5), (0, 1, 0.5), (1, 2, 1.0), (2, 0, 0.3), (2, 1, 0.6), (2, 9, 0.1), (9, 9, 1.0)]
    got = {(r["i"], r["j"]): r["steps"] for r in transitions.first_passage(table(spark, rows, "i int, j int, p double")).collect()}
    p = np.array([[0.5, 0.5, 0], [0, 0, 1], [1 / 3, 2 / 3, 0]])
    for j in range(3):
        for i in range(3):
            if i != j:
                at, want = np.eye(3)[i], 0.0
                for _ in range(2000):
                    want += at.sum()
                    at = at @ p
                    at[j] = 0
                assert got[i, j] == pytest.approx(want)
    assert len(got) == 6 and transitions.first_passage(table(spark, [], "i int, j int, p double")).count() == 0


def test_reliable_states_without_excluded(spark):
    states = table(spark, [(r, t, t % 2) for r in range(30) for t in range(4)], "run long, tr int, state int")
    every = blocks.state_blocks(states)
    assert {r["state"] for r in transitions.reliable_states(states, every).collect()} == {0, 1}
    assert {r["state"] for r in transitions.reliable_states(states, every, excluded=table(spark, [(1,)], "state int")).collect()} == {0}


def test_shrunk_correlations(spark):
    from strandline.operators import similarity

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 3))
    rows = [(0, n, d, float(v)) for n, row in enumerate(x) for d, v in enumerate(row)] + [(1, 99, d, 1.0) for d in range(3)]
    got = {(r["state"], r["i"], r["j"]): r for r in similarity.shrunk_correlations(table(spark, rows, "state int, obs long, dim int, x double")).collect()}
    c = x - x.mean(axis=0)
    cov, mu = c.T @ c / 40, np.trace(c.T @ c / 40) / 3
    spread = sum(np.linalg.norm(np.outer(r, r) - cov) ** 2 for r in c) / 40**2 / 3
    apart = np.linalg.norm(cov - mu * np.eye(3)) ** 2 / 3
    s = min(spread, apart) / apart
    want = (1 - s) * cov + s * mu * np.eye(3)
    for (state, i, j), r in got.items():
        if state == 0:
            assert r["shrinkage"] == pytest.approx(s) and r["r"] == pytest.approx(want[i, j] / math.sqrt(want[i, i] * want[j, j])) and r["reliable"]
        else:
            assert r["r"] == (1.0 if i == j else 0.0) and not r["reliable"]
    assert len(got) == 12

"""Fitted models: components and regressions against numpy, hidden Markov steps against plain sums, decoders against refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import decoding as M
from strandline.operators import fitting as H
from strandline.operators import linear as L
from strandline.operators import ridge as C


def frame(spark, x, extra="run long, tr int", keys=None):
    keys = keys or [(i // 10, i % 10) for i in range(len(x))]
    return spark.createDataFrame([(*k, [float(v) for v in row]) for k, row in zip(keys, x)], f"{extra}, features array<double>")


def test_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 1000
    rows = frame(spark, x)
    odd = rows.union(spark.createDataFrame([(99, 0, None), (99, 1, [float("nan")] * 6), (99, 2, [None] * 6)], rows.schema))
    fit = L.fit_components(odd)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert fit.n == 200 and np.allclose(fit.mean, x.mean(axis=0)) and np.allclose(fit.variances, values[::-1], rtol=1e-8)
    assert np.allclose(np.abs((fit.components * vectors.T[::-1]).sum(axis=1)), 1)
    assert all(c[np.abs(c).argmax()] > 0 for c in fit.components)
    shares = np.cumsum(values[::-1]) / values.sum()
    assert [fit.n_components(s) for s in (0.5, 0.9, 1.1)] == [int((shares < 0.5).sum()) + 1, int((shares < 0.9).sum()) + 1, 6]
    z = {(r.run, r.tr): r.features for r in L.projected(odd.where("features is null or run < 99"), fit, 3).collect()}
    assert z[99, 0] is None and all(np.allclose(z[i // 10, i % 10], (x[i] - x.mean(axis=0)) @ fit.components[:3].T, atol=1e-8) for i in range(200))
    with pytest.raises(ValueError):
        L.fit_components(rows.limit(0))


def test_back_projection_of_diagonals_and_covariances(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 5))
    fit = L.fit_components(frame(spark, x))
    w = fit.components[:3]
    mean, diag, full = rng.normal(size=3), rng.uniform(1, 2, 3), np.cov(rng.normal(size=(3, 20)))
    for cov in (diag, full.ravel()):
        states = spark.createDataFrame([(4, mean.tolist(), cov.tolist())], "state int, mean array<double>, cov array<double>")
        got = L.back_projected(states, fit).first()
        assert np.allclose(got.mean, mean @ w + fit.mean) and np.allclose(np.reshape(got.cov, (5, 5)), w.T @ (np.diag(diag) if len(cov) == 3 else full) @ w)


def test_parcels_and_residual_variance(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    group = np.repeat([1, 2, 3], 20)
    rows = spark.createDataFrame([(i, 0, int(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(group, x))], "run long, tr int, g int, features array<double>")
    got = {r.run: r.features for r in L.parcel_means(rows, [3, None, 1, 3, 1]).collect()}
    assert all(np.allclose(got[i], [0, r[[2, 4]].mean(), 0, r[[0, 3]].mean()]) for i, r in enumerate(x))
    shares = L.residual_variance(L.fit_components(rows), 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    signal = (vectors[:, -2:] ** 2 * values[-2:]).sum(axis=1)
    assert np.allclose(shares[:, 0], signal) and np.allclose(shares[:, :2].sum(axis=1), x.var(axis=0, ddof=1)) and np.allclose(shares[:, 2], 1 - signal / x.var(axis=0, ddof=1))
    left = L.components_without(rows, "g")
    assert set(left) == {1, 2, 3} and all(np.allclose(c.variances, np.linalg.eigvalsh(np.cov(x[group != g].T))[::-1]) and c.n == 40 for g, c in left.items())
    folds = np.array([L.residual_variance(left[g], 2)[:, 2] for g in (1, 2, 3)])
    assert np.allclose([r[1:] for r in L.residual_stability(rows, "g", 2)], np.column_stack([shares[:, 2], folds.mean(axis=0), folds.std(axis=0), folds.std(axis=0) / folds.mean(axis=0)]))
    fit = L.fit_components(rows)
    bare = np.array([r.features for r in L.without_components(rows, fit, 2).orderBy("run").collect()])
    assert np.allclose(bare @ fit.components[:2].T, 0) and np.allclose(bare + (x @ fit.components[:2].T) @ fit.components[:2], x)


def test_cleaned(spark):
    """Dependent confounds, missing entries, a feature that confounds explain wholly and one without variation."""
    rng = np.random.default_rng(3)
    n = 40
    c = rng.normal(size=(n, 2)).cumsum(axis=0)
    c = np.column_stack([c, c[:, 0] * 2 - 1, np.ones(n)])
    x = np.column_stack([rng.normal(size=n), np.arange(n) * 3 + c[:, 1] + 5, np.full(n, 7.0), rng.normal(size=n)])
    rows = [(1, t, [float(v) for v in x[t]], [None if t == 3 and k == 0 else float(v) for k, v in enumerate(c[t])]) for t in range(n)]
    rows = [(r, t, [*f[:3], None if t == 5 else f[3]], k) for r, t, f, k in rows] + [(2, 0, [1.0] * 4, [0.0] * 4)]
    got = {(r.run, r.tr): r.features for r in L.cleaned(spark.createDataFrame(rows[::-1], "run long, tr int, features array<double>, confounds array<double>")).collect()}
    c[3, 0] = 0
    design = np.column_stack([np.ones(n), np.arange(n), c])
    rest = x[:, 0] - design @ np.linalg.lstsq(design, x[:, 0], rcond=None)[0]
    assert np.allclose([got[1, t][0] for t in range(n)], rest / rest.std(ddof=1), atol=1e-7)
    assert all(got[1, t][1] == 0 and got[1, t][2] == 0 and got[1, t][3] is None for t in range(n)) and got[2, 0] == [0.0] * 4


def test_least_squares(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(3):
        a, b = rng.normal(size=30) + 100, rng.normal(size=30)
        y = 2 * a - b + rng.normal(size=30) * 0.1 + g
        rows += [(g, float(p), float(q), float(2 * p), float(v)) for p, q, v in zip(a, b, y)]
        design = np.column_stack([np.ones(30), a, b])
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        want[g] = (design @ beta, 1 - ((y - design @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    rows += [(7, 1.0, 2.0, 2.0, None), (7, 1.0, None, 2.0, 1.0), (8, 1.0, 1.0, 2.0, 3.0), (8, 2.0, 5.0, 4.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, twice double, y double")
    fit = {r.g: r for r in L.least_squares(df, "y", ["a", "b", "twice"], ["g"]).collect()}
    assert set(fit) == {0, 1, 2, 8} and fit[8].r2 is None and all(abs(fit[g].r2 - want[g][1]) < 1e-9 for g in want)
    rest = L.least_squares_residual(df, "y", ["a", "b", "twice"], ["g"]).collect()
    for g in want:
        own = [r for r in rest if r.g == g]
        assert np.allclose(sorted(r.y - r.residual for r in own), sorted(want[g][0]), atol=1e-7)
    assert sum(r.residual is None for r in rest) == 2


# hidden Markov models


def plain_counts(model, runs, outer):
    """Expected counts run by run in logarithms, one move at a time."""
    k, d = model.means.shape
    lse = lambda v, axis=None: np.logaddexp.reduce(v, axis=axis)
    out = H.Counts(0.0, np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d) if outer else (k, d)))
    for x in runs:
        dens = np.zeros((len(x), k))
        for t in range(len(x)):
            for s in range(k):
                cov = model.variances[s] if model.variances.ndim == 3 else np.diag(model.variances[s])
                gap = x[t] - model.means[s]
                dens[t, s] = -0.5 * (gap @ np.linalg.inv(cov) @ gap + np.log(np.linalg.det(cov)) + d * np.log(2 * np.pi))
        with np.errstate(divide="ignore"):
            la, ls = np.log(model.transitions), np.log(model.start)
        f, b = np.zeros_like(dens), np.zeros_like(dens)
        f[0] = ls + dens[0]
        for t in range(1, len(x)):
            f[t] = lse(f[t - 1][:, None] + la, 0) + dens[t]
        for t in range(len(x) - 2, -1, -1):
            b[t] = lse(la + (dens[t + 1] + b[t + 1])[None], 1)
        total = lse(f[-1])
        post = np.exp(f + b - total)
        out.log_likelihood += total
        out.start += post[0]
        out.usage += post.sum(axis=0)
        out.weight += post.sum(axis=0)
        out.first += post.T @ x
        out.second += np.einsum("tk,ti,tj->kij", post, x, x) if outer else post.T @ (x * x)
        for t in range(len(x) - 1):
            out.moves += np.exp(f[t][:, None] + la + (dens[t + 1] + b[t + 1])[None] - total)
    return out


def planted(seed, k=3, d=2, lengths=(60, 1, 35, 80, 2, 50), far=4.0):
    rng = np.random.default_rng(seed)
    a = np.full((k, k), 0.1 / (k - 1)) + (0.9 - 0.1 / (k - 1)) * np.eye(k)
    angle = 2 * np.pi * np.arange(k) / k
    means = far * np.column_stack([np.cos(angle), np.sin(angle)])[:, :d]
    runs, paths = [], []
    for n in lengths:
        s = [int(rng.integers(k))]
        for _ in range(n - 1):
            s.append(int(rng.choice(k, p=a[s[-1]])))
        paths.append(s)
        runs.append(means[s] + rng.normal(size=(n, d)))
    return a, means, runs, paths


def run_frame(spark, runs, seed=0):
    rows = [(r, t, [float(v) for v in x]) for r, run in enumerate(runs) for t, x in enumerate(run)]
    np.random.default_rng(seed).shuffle(rows)
    return spark.createDataFrame([(int(r), int(t), list(map(float, f))) for r, t, f in rows], "run long, tr int, features array<double>")


@pytest.mark.parametrize("covariance", H.COVARIANCES)
def test_one_step_equals_a_plain_one(spark, covariance):
    a, means, runs, _ = planted(5)
    k, d = means.shape
    outer = covariance in ("full", "tied")
    variances = np.tile(np.array([[2.0, 0.5], [0.5, 1.0]]), (k, 1, 1)) if outer else np.full((k, d), 1.5)
    model = M.GaussianModel(np.array([0.2, 0.5, 0.3]), a, means + 0.5, variances)
    got, want = H.expected_counts(H.packed_runs(run_frame(spark, runs)), model, outer), plain_counts(model, runs, outer)
    assert np.allclose(got.flat(), want.flat(), rtol=1e-8, atol=1e-8)
    prior, weights = H.StickyPrior(3.0, 2.0, 5.0, 0.5), np.array([0.5, 0.3, 0.2])
    new, beta = H.maximised(got, model, weights, prior, covariance, 1e-3)
    rows = want.moves + 3.0 * weights + 2.5 * np.eye(k)
    assert np.allclose(new.transitions, rows / rows.sum(axis=1, keepdims=True)) and np.allclose(new.means, want.first / want.usage[:, None])
    share = 2.0 * weights + rows.sum(axis=0)
    assert np.allclose(beta, share / share.sum()) and np.allclose(new.start, (want.start + 3.0 * beta) / (want.start.sum() + 3.0))
    if covariance == "diag":
        assert np.allclose(new.variances, want.second / want.usage[:, None] - new.means**2)
    elif covariance == "full":
        assert np.allclose(new.variances, want.second / want.usage[:, None, None] - np.einsum("ki,kj->kij", new.means, new.means) + 1e-3 * np.eye(d))
    assert new.variances.shape == variances.shape


@pytest.mark.parametrize("covariance", ["diag", "full"])
def test_fit_recovers_a_planted_chain_and_never_loses_likelihood(spark, covariance):
    a, means, runs, paths = planted(8, lengths=(120, 90, 150, 1, 200))
    rows = run_frame(spark, runs)
    fit = H.fit_hmm(rows, 3, H.StickyPrior(0.0, 5.0, 0.0, 0.0), covariance, n_iter=12, least_variance=1e-9, seed=1)
    seen = [h["log_likelihood"] for h in fit.history]
    assert all(b >= x - 1e-7 * abs(x) for x, b in zip(seen, seen[1:])) and not fit.converged
    to = np.array([np.linalg.norm(fit.model.means - m, axis=1).argmin() for m in means])
    assert sorted(to) == [0, 1, 2] and np.abs(fit.model.means[to] - means).max() < 0.5 and np.abs(fit.model.transitions[np.ix_(to, to)] - a).max() < 0.08
    got = {(r.run, r.tr): r.state for r in M.decoded(rows, fit.model).collect()}
    assert np.mean([got[r, t] == to[s] for r, path in enumerate(paths) for t, s in enumerate(path)]) > 0.95
    scores = {r.run: r.log_likelihood for r in H.run_likelihoods(rows, fit.model).collect()}
    assert abs(sum(scores.values()) - plain_counts(fit.model, runs, False).log_likelihood) < 1e-6 * abs(seen[-1])


def test_fit_stops_when_windows_agree_and_copes_with_odd_rows(spark):
    _, _, runs, _ = planted(9, lengths=(40, 40))
    rows = run_frame(spark, runs)
    odd = rows.union(spark.createDataFrame([(0, 40, [float("nan"), 1.0]), (7, 0, None), (None, 1, [1.0, 1.0])], rows.schema))
    fit = H.fit_hmm(odd, 4, n_iter=40, window=3, tolerance=1e-3, seed=2)
    assert fit.converged and len(fit.history) < 40 and np.isfinite(fit.model.means).all()
    assert abs(sum(fit.history[0]["usage"]) - 1) < 1e-9 and H.history(fit, spark).count() == len(fit.history)
    few = H.fit_hmm(run_frame(spark, [np.ones((3, 2))]), 3, n_iter=2)  # fewer distinct rows than states
    assert np.isfinite(few.model.transitions).all()
    with pytest.raises(ValueError):
        H.fit_hmm(rows.limit(0), 2)


# decoders


def plain_ridge(x, y, labels, runs, alpha):
    """Scores (rows, labels, columns) of held-out runs, each fold fitted anew on weighted, centred rows."""
    classes = np.unique(y)
    k = len(classes)
    out = {}
    for r in np.unique(runs):
        train, test = runs != r, runs == r
        counts = np.array([(y[train] == c).sum() for c in classes])
        if (counts == 0).any():
            continue
        w = (train.sum() / (k * counts))[np.searchsorted(classes, y[train])]
        mean = np.average(x[train], axis=0, weights=w)
        xc = (x[train] - mean) * np.sqrt(w)[:, None]
        scores = []
        for lab in labels:
            t = np.where(lab[train][:, None] == (classes if k > 2 else classes[1:])[None], 1.0, -1.0)
            off = np.average(t, axis=0, weights=w)
            coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ ((t - off) * np.sqrt(w)[:, None]))
            scores.append((x[test] - mean) @ coef + off)
        for at, i in enumerate(np.flatnonzero(test)):
            out[i] = np.stack([s[at] for s in scores])
    return classes, out


@pytest.mark.parametrize("k", [2, 4])
def test_ridge_folds_equal_refits(spark, k):
    rng = np.random.default_rng(k)
    runs = np.repeat(np.arange(5), 40)
    y = rng.choice(np.array([0, 3, 5, 200])[:k], 200)
    y[runs == 4] = y[0]
    y[:k] = np.array([0, 3, 5, 200])[:k]
    x = rng.normal(size=(200, 8)) + 0.8 * np.searchsorted(np.unique(y), y)[:, None] + 50
    labels = [y, rng.permutation(y), np.roll(y, 17)]
    rows = [(int(r), int(i % 40), [float(v) for v in x[i]], int(y[i]), int(labels[1][i]), int(labels[2][i])) for i, r in enumerate(runs)]
    rows += [(9, 0, None, 0, 0, 0), (1, 99, [float("nan")] * 8, 0, 0, 0), (1, 98, [1.0] * 8, None, 0, 0)]
    df = spark.createDataFrame(rows, "run long, tr int, features array<double>, label int, n1 int, n2 int")
    scored = C.leave_one_run_out(df, ["label", "n1", "n2"], alpha=2.0)
    got = scored.collect()
    classes, want = plain_ridge(x, y, labels, runs, 2.0)
    assert len(got) == 3 * len(want)
    for r in got:
        s = want[r.run * 40 + r.tr][r.target]
        assert np.allclose(r.scores, s, atol=1e-7) and r.label == labels[r.target][r.run * 40 + r.tr]
        assert r.predicted == (classes[int(s[0] > 0)] if k == 2 else classes[s.argmax()])
    metrics = {r.target: r for r in C.decoding_metrics(scored).collect()}
    for b, lab in enumerate(labels):
        keep = sorted(want)
        true, said = lab[keep], np.array([classes[int(want[i][b][0] > 0)] if k == 2 else classes[want[i][b].argmax()] for i in keep])
        recall = np.mean([(said[true == c] == c).mean() for c in np.unique(true)])
        assert metrics[b].n == len(keep) and abs(metrics[b].balanced_accuracy - recall) < 1e-9
        chance = sum((true == c).mean() * (said == c).mean() for c in classes)
        assert abs(metrics[b].kappa - ((true == said).mean() - chance) / (1 - chance)) < 1e-9
    areas = {(r.target, r.state): r.auc for r in C.state_areas(scored, classes.tolist()).collect()}
    for b, lab in enumerate(labels):
        for place, c in enumerate(classes):
            s = np.array([(want[i][b][0] * (1 if place else -1)) if k == 2 else want[i][b][place] for i in sorted(want)])
            pos, neg = s[lab[sorted(want)] == c], s[lab[sorted(want)] != c]
            assert abs(areas[b, int(c)] - ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())) < 1e-9


def test_ridge_odd_rows(spark):
    schema = "run long, tr int, features array<double>, label int"
    assert C.leave_one_run_out(spark.createDataFrame([], schema), ["label"]).count() == 0
    one = spark.createDataFrame([(1, 0, [1.0], 3), (2, 0, [2.0], 3)], schema)
    assert C.leave_one_run_out(one, ["label"]).count() == 0
    lone = spark.createDataFrame([(1, 0, [1.0], 3), (1, 1, [2.0], 4), (2, 0, [2.0], 3)], schema)
    assert {r.run for r in C.leave_one_run_out(lone, ["label"]).collect()} == {2}
    with pytest.raises(ValueError):
        C.leave_one_run_out(lone.withColumn("other", F.lit(9)), ["label", "other"])


def test_ranked_areas_split_hot_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(s), bool(b)) for g, s, b in zip(rng.integers(0, 2, 500), rng.integers(0, 30, 500), rng.random(500) < 0.3)] + [(5, 1.0, True), (0, None, True), (0, 1.0, None)]
    got = {r.g: r for r in C.ranked_areas(spark.createDataFrame(rows, "g int, s double, y boolean"), "s", "y", ["g"]).collect()}
    for g in (0, 1):
        pos, neg = (np.array([s for h, s, y in rows if h == g and s is not None and y is want]) for want in (True, False))
        assert abs(got[g].auc - ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())) < 1e-9 and (got[g].n_pos, got[g].n_neg) == (len(pos), len(neg))
    assert got[5].auc is None

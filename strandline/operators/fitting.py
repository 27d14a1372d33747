"""Fitting a sticky hidden Markov model with a hierarchical Dirichlet prior (weak limit) to many runs.

Expectation maximisation as a loop of Spark jobs: every run is one row of a working table; an expectation step sends the
model to the tasks, each of which adds up the expected counts of its runs, and Spark adds up the tasks. The driver holds
the model and one set of counts, whose sizes follow from states and features alone. A run is never gathered with others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.decoding import TINY, GaussianModel
from strandline.operators.linear import finite_rows, summed, width_of
from strandline.sources.working import written

COVARIANCES = ("diag", "full", "tied", "spherical")


@dataclass
class StickyPrior:
    """alpha: weight of the shared state weights in each row; gamma: of themselves; kappa * rho: extra weight of staying."""

    alpha: float = 10.0
    gamma: float = 10.0
    kappa: float = 50.0
    rho: float = 0.1


@dataclass
class Fit:
    """A fitted model with its shared state weights; history has a dict for each step: log_likelihood, active_states, usage."""

    model: GaussianModel
    weights: np.ndarray
    covariance: str
    converged: bool = False
    history: list[dict] = field(default_factory=list)


@dataclass
class Counts:
    """Expected counts of one expectation step; `second` are sums of squares (K, D) or of outer products (K, D, D)."""

    log_likelihood: float
    start: np.ndarray
    moves: np.ndarray
    usage: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def shapes(k: int, d: int, outer: bool) -> list[tuple[int, ...]]:
        return [(), (k,), (k, k), (k,), (k,), (k, d), (k, d, d) if outer else (k, d)]

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(x) for x in (self.log_likelihood, self.start, self.moves, self.usage, self.weight, self.first, self.second)])

    @classmethod
    def unflat(cls, v: np.ndarray, k: int, d: int, outer: bool) -> Counts:
        out, at = [], 0
        for shape in cls.shapes(k, d, outer):
            size = int(np.prod(shape, dtype=int))
            out.append(v[at : at + size].reshape(shape))
            at += size
        return cls(float(out[0]), *out[1:])


def packed_runs(rows: DataFrame, features: str = "features") -> DataFrame:
    """(run, n, x): a row for each run with its features in order of tr, one after the other; written. Rows without features are left out."""
    held = rows.where(f"`{features}` is not null and run is not null").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("tr", F.col(features).cast("array<double>").alias("f")))).alias("r"))
    return written(held.select("run", F.size("r").alias("n"), F.flatten("r.f").alias("x")), "hmm-runs")


def expectations(model: GaussianModel, x: np.ndarray, lengths: np.ndarray, outer: bool) -> Counts:
    """Expected counts over runs that stand one after the other in x, by scaled forward and backward passes over all of them at once.

    An observation with a non-finite entry tells nothing about the state and adds nothing to the emission sums.
    """
    seen = np.isfinite(x).all(axis=1)
    x = np.where(seen[:, None], x, 0.0)
    density = np.where(seen[:, None], model.log_density(x), 0.0)
    top = density.max(axis=1, keepdims=True)
    like = np.exp(density - top)
    order = np.argsort(-lengths, kind="stable")
    offsets = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # runs longer than t
    forward, backward, scale = np.zeros(like.shape), np.ones(like.shape), np.ones(len(x))
    for t, n in enumerate(alive):
        at = offsets[:n] + t
        a = (np.broadcast_to(model.start, (n, len(model.start))) if t == 0 else forward[at - 1] @ model.transitions) * like[at]
        s = a.sum(axis=1)
        scale[at] = np.where(s > 0, s, TINY)
        forward[at] = a / scale[at, None]
    moves = np.zeros(model.transitions.shape)
    for t in range(len(alive) - 2, -1, -1):
        at = offsets[: alive[t + 1]] + t
        ahead = like[at + 1] * backward[at + 1] / scale[at + 1, None]
        backward[at] = ahead @ model.transitions.T
        moves += forward[at].T @ ahead
    both = forward * backward
    total = both.sum(axis=1, keepdims=True)
    post = both / np.where(total > 0, total, 1.0)
    weighted = post * seen[:, None]
    second = np.stack([(x * w[:, None]).T @ x for w in weighted.T]) if outer else weighted.T @ (x * x)
    start = post[offsets].sum(axis=0) if len(offsets) else np.zeros(len(model.start))
    return Counts(float(np.log(scale).sum() + top.sum()), start, moves * model.transitions, post.sum(axis=0), weighted.sum(axis=0), weighted.T @ x, second)


def expected_counts(runs: DataFrame, model: GaussianModel, outer: bool) -> Counts:
    """The expectation step over all rows of `packed_runs`."""
    k, d = model.means.shape
    size = sum(int(np.prod(s, dtype=int)) for s in Counts.shapes(k, d, outer))

    def counts(piece: pa.RecordBatch) -> np.ndarray:
        lengths = piece.column(0).to_numpy().astype(np.int64)
        out, at, flat = np.zeros(size), 0, piece.column(1).flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        while at < len(lengths):  # some 8,000 observations at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8_000, side="right")))
            a, b = (int(ends[at - 1]) if at else 0), int(ends[to - 1])
            out += expectations(model, flat[a * d : b * d].reshape(-1, d), lengths[at:to], outer).flat()
            at = to
        return out

    return Counts.unflat(summed(runs.where("n > 0"), ["n", "x"], size, counts), k, d, outer)


def maximised(counts: Counts, model: GaussianModel, weights: np.ndarray, prior: StickyPrior, covariance: str, least_variance: float) -> tuple[GaussianModel, np.ndarray]:
    """Model and shared state weights from expected counts.

    Means are weighted averages. Transition rows are expected moves plus alpha times the weights plus kappa * rho for staying,
    scaled; the weights then take gamma times themselves plus what enters each state; the start takes the first
    observations plus alpha times the new weights.
    """
    k, d = counts.first.shape
    eps = 10 * np.finfo(float).eps
    means = counts.first / (counts.weight[:, None] + eps)
    if covariance in ("diag", "spherical"):
        var = counts.second / (counts.weight[:, None] + eps) - means**2
        if covariance == "spherical":
            var = np.full((k, d), (var * counts.weight[:, None]).sum() / max(counts.weight.sum() * d, eps))
        covariances = np.maximum(var, least_variance)
    else:
        grown = least_variance * np.eye(d)
        if covariance == "tied":
            own = (counts.second.sum(axis=0) - np.einsum("k,ki,kj->ij", counts.weight, means, means)) / max(counts.weight.sum(), eps)
            own = np.broadcast_to(own, (k, d, d))
        else:
            held = np.maximum(counts.weight, 1e-10)[:, None, None]
            own = np.where(counts.weight[:, None, None] > 1e-10, counts.second / held - np.einsum("ki,kj->kij", means, means), 0.0)
        values, vectors = np.linalg.eigh((own + own.transpose(0, 2, 1)) / 2 + grown)
        covariances = np.einsum("kij,kj,klj->kil", vectors, np.maximum(values, least_variance), vectors)
    rows = np.maximum(counts.moves + prior.alpha * weights[None] + prior.kappa * prior.rho * np.eye(k), 0.0)
    total = rows.sum(axis=1, keepdims=True)
    transitions = np.where(total > 1e-40, rows / np.where(total > 1e-40, total, 1.0), 1.0 / k)
    weights = prior.gamma * weights + rows.sum(axis=0) + 1e-20
    weights = weights / weights.sum()
    start = counts.start + prior.alpha * weights
    start = start / start.sum() if start.sum() > 0 else np.full(k, 1.0 / k)
    return GaussianModel(start, transitions, means, covariances), weights


def first_model(rows: DataFrame, n_states: int, prior: StickyPrior, covariance: str, least_variance: float, seed: int, features: str = "features") -> tuple[GaussianModel, np.ndarray]:
    """Centres by k-means over all rows, the overall covariance for every state, weights by stick breaking."""
    if covariance not in COVARIANCES:
        raise ValueError(f"covariance must be one of {COVARIANCES}")
    whole = finite_rows(rows, features).select(F.col(features).cast("array<double>").alias("f"))
    d = width_of(whole, "f")
    if not d:
        raise ValueError("no row has finite features")
    shift = np.array(whole.first()[0])

    def products(piece: pa.RecordBatch) -> np.ndarray:
        x = piece.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - shift
        x = np.column_stack([np.ones(len(x)), x])
        return (x.T @ x).ravel()

    m = summed(whole, ["f"], (d + 1) ** 2, products).reshape(d + 1, d + 1)
    centre = m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / m[0, 0] - np.outer(centre, centre)
    spread = np.sqrt(np.maximum(np.diag(cov), least_variance))
    draw = np.random.default_rng(seed)
    found = np.array(KMeans(k=n_states, seed=seed, featuresCol="v").fit(whole.select(array_to_vector("f").alias("v"))).clusterCenters()) if n_states > 1 else (shift + centre)[None]
    if len(found) < n_states:  # fewer distinct rows than states
        found = np.vstack([found, shift + centre + spread * draw.standard_normal((n_states - len(found), d))])
    found = found[np.lexsort(found.T[::-1])]  # states in the order of their centres
    if covariance == "diag":
        covariances = np.tile(np.maximum(np.diag(cov), least_variance), (n_states, 1))
    elif covariance == "spherical":
        covariances = np.full((n_states, d), max(np.diag(cov).mean(), least_variance))
    else:
        covariances = np.tile(cov + least_variance * np.eye(d), (n_states, 1, 1))
    cuts = draw.beta(1, max(prior.gamma, 1e-6), n_states)
    weights = cuts * np.r_[1.0, np.cumprod(1 - cuts)[:-1]]
    weights = weights / weights.sum()
    rows_ = weights[None] + prior.kappa * prior.rho * np.eye(n_states)
    return GaussianModel(weights.copy(), rows_ / rows_.sum(axis=1, keepdims=True), found, covariances), weights


def fit_hmm(
    rows: DataFrame, n_states: int, prior: StickyPrior | None = None, covariance: str = "diag", n_iter: int = 100, min_iter: int = 0, tolerance: float = 1e-4, window: int = 100,
    least_variance: float = 1e-3, least_usage: float = 0.01, seed: int = 0, start: tuple[GaussianModel, np.ndarray] | None = None, features: str = "features",
) -> Fit:
    """Fit to rows (run, tr, features). It stops after `n_iter` steps, or after at least min_iter + 2 * window where the mean
    log likelihoods of the last two windows differ by less than `tolerance` in proportion.

    No state is taken away; `active_states` counts those above `least_usage` of all observations. A run without rows
    does not exist; runs of one TR have no moves; equal rows count each. No finite row: an error.
    """
    prior = prior or StickyPrior()
    model, weights = start or first_model(rows, n_states, prior, covariance, least_variance, seed, features)
    fit = Fit(model, weights, covariance)
    runs = packed_runs(rows, features)
    for _ in range(n_iter):
        counts = expected_counts(runs, fit.model, covariance in ("full", "tied"))
        fit.model, fit.weights = maximised(counts, fit.model, fit.weights, prior, covariance, least_variance)
        usage = counts.usage / max(counts.usage.sum(), 1e-10)
        fit.history.append({"log_likelihood": counts.log_likelihood, "active_states": int((usage > least_usage).sum()), "usage": usage})
        seen = [h["log_likelihood"] for h in fit.history]
        if len(seen) >= max(min_iter, 1) + 2 * window:
            before, after = np.mean(seen[-2 * window : -window]), np.mean(seen[-window:])
            if abs(after - before) / max(abs(after), 1e-10) < tolerance:
                fit.converged = True
                break
    return fit


def history(fit: Fit, spark) -> DataFrame:
    """(iteration from 0, log_likelihood, active_states): one row a step."""
    return spark.createDataFrame([(i, h["log_likelihood"], h["active_states"]) for i, h in enumerate(fit.history)], "iteration int, log_likelihood double, active_states int")


def run_likelihoods(rows: DataFrame, model: GaussianModel, features: str = "features") -> DataFrame:
    """(run, n, log_likelihood) of every run under a model, for held-out runs and comparisons of fits."""
    d = model.means.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).to_numpy().astype(np.int64)
            parts = np.split(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), np.cumsum(lengths)[:-1])
            found = [expectations(model, x, np.array([len(x)]), False).log_likelihood for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["run", "n", "log_likelihood"])

    runs = packed_runs(rows, features)
    return runs.mapInArrow(score, f"run {dict(runs.dtypes)['run']}, n int, log_likelihood double")

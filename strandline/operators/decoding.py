"""State decoding of multivariate runs by a Gaussian hidden Markov model: likeliest paths and posteriors.

A run is one sequence, so each run is one group of a task (bounded by the run's length); models are small and go along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TINY = 1e-10


@dataclass
class GaussianModel:
    """start (K,), transitions (K, K), means (K, D) and variances: diagonals (K, D) or whole covariances (K, D, D)."""

    start: np.ndarray
    transitions: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(T, K) log densities; values that are not finite count as very unlikely."""
        if self.variances.ndim == 3:
            roots = np.linalg.cholesky(self.variances)
            gaps = np.stack([(np.linalg.solve(r, (x - m).T) ** 2).sum(axis=0) for r, m in zip(roots, self.means)], axis=1)
            size = 2 * np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1) + x.shape[1] * np.log(2 * np.pi)
        else:  # the square, expanded: two products instead of a (T, K, D) array
            centre = self.means.mean(axis=0)
            y, m, w = x - centre, self.means - centre, 1 / self.variances
            gaps = np.maximum((y * y) @ w.T - 2 * y @ (m * w).T + (m * m * w).sum(axis=1), 0.0)
            size = np.log(2 * np.pi * self.variances).sum(axis=1)
        return np.nan_to_num(-0.5 * (gaps + size), nan=-1e10, posinf=-1e10, neginf=-1e10)

    def kept(self, states: list[int]) -> GaussianModel:
        """The model of these states alone, start and rows scaled to 1; a row without any mass is even."""
        start, rows = self.start[states], self.transitions[np.ix_(states, states)]
        even = np.full(len(states), 1 / len(states))
        scaled = np.array([r / r.sum() if r.sum() > 0 else even for r in rows])
        return GaussianModel(start / start.sum() if start.sum() > 0 else even, scaled, self.means[states], self.variances[states])


def best_path(model: GaussianModel, x: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest state of every TR and the path's log probability; ties go to the smaller state."""
    density, step = model.log_density(x), np.log(model.transitions + TINY)
    score = np.log(model.start + TINY) + density[0]
    back = np.zeros(density.shape, np.int32)
    for t in range(1, len(x)):
        offer = score[:, None] + step
        back[t] = offer.argmax(axis=0)
        score = offer[back[t], np.arange(len(score))] + density[t]
    path = np.zeros(len(x), np.int32)
    path[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(score.max())


def posteriors(model: GaussianModel, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(T, K) state probabilities given the whole run, and the run's log likelihood, by scaled forward and backward passes."""
    density = model.log_density(x)
    top = density.max(axis=1, keepdims=True)
    like = np.exp(density - top)
    forward, scale = np.zeros(like.shape), np.zeros(len(x))
    for t in range(len(x)):
        a = (model.start if t == 0 else forward[t - 1] @ model.transitions) * like[t]
        scale[t] = a.sum() or TINY
        forward[t] = a / scale[t]
    backward = np.ones(like.shape)
    for t in range(len(x) - 2, -1, -1):
        backward[t] = model.transitions @ (like[t + 1] * backward[t + 1]) / scale[t + 1]
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), float(np.log(scale).sum() + top.sum())


def decoded(rows: DataFrame, model: GaussianModel, usage: dict[int, float] | None = None, least: float = 0.0) -> DataFrame:
    """(run long, tr int, state int, log_prob double) of rows (run, tr, features array<double>).

    With `usage`, states used less than `least` are left out before decoding; states keep their numbers.
    """
    states = [k for k in range(len(model.start)) if usage is None or usage.get(k, 0.0) >= least]
    used = model.kept(states)

    def one(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("tr")
        path, score = best_path(used, np.array(run["features"].tolist(), float))
        return pd.DataFrame({"run": run["run"], "tr": run["tr"], "state": np.array(states, np.int32)[path], "log_prob": score})

    return rows.select("run", "tr", "features").groupBy("run").applyInPandas(one, "run long, tr int, state int, log_prob double")


def scored(rows: DataFrame, model: GaussianModel) -> DataFrame:
    """(run long, tr int, probabilities array<double>, log_likelihood double): posteriors of every TR."""

    def one(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("tr")
        p, total = posteriors(model, np.array(run["features"].tolist(), float))
        return pd.DataFrame({"run": run["run"], "tr": run["tr"], "probabilities": list(p), "log_likelihood": total})

    return rows.select("run", "tr", "features").groupBy("run").applyInPandas(one, "run long, tr int, probabilities array<double>, log_likelihood double")

"""Linear models over observations: moments, principal components, projection both ways, confound regression.

Sums run on executors: a task adds up its rows' products in one matrix, Spark adds these up. What reaches the driver is
one matrix of the width of the features, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_rows(rows: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose features are there, without a null or non-finite entry."""
    x = F.col(features)
    return rows.where(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of numbers as one array of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def pieces(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def summed(rows: DataFrame, columns: list[str], size: int, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of f(piece) (`size` numbers) over pieces of the rows: one partial sum a task, added up by Spark by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for piece in pieces(batch):
                total += f(piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    parts = rows.select(*columns).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in parts.toLocalIterator():
        out[r["i"]] = r["v"]
    return out


def width_of(rows: DataFrame, features: str = "features") -> int:
    first = rows.select(F.size(features).alias("d")).first()
    return first["d"] if first else 0


def moments(rows: DataFrame, by: str, features: str = "features", shift: np.ndarray | None = None) -> DataFrame:
    """(by, i, j, s) for i <= j: sums of products of (1, features - shift), so (0, 0) counts rows and (0, j) sums feature j - 1.

    A task sends one matrix for each value of `by` it meets in a batch, so values may be many; `by` must be a number and
    rows with a null one are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                keys, x = piece.column(0).to_numpy(), matrix(piece.column(1))
                x = np.column_stack([np.ones(len(x)), x if shift is None else x - shift])
                for key in np.unique(keys):
                    own = x[keys == key]
                    held[int(key)] = held.get(int(key), 0.0) + own.T @ own
                if len(held) > 64:
                    yield from sent(held)
                    held = {}
        yield from sent(held)

    def sent(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), key)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["key", "i", "j", "s"])

    whole = finite_rows(rows.where(F.col(by).isNotNull()), features).select(F.col(by).cast("long").alias("key"), features)
    return whole.mapInArrow(run, "key long, i int, j int, s double").groupBy(F.col("key").alias(by), "i", "j").agg(F.sum("s").alias("s"))


def covariances(rows: DataFrame, by: str, features: str = "features", ddof: int = 1) -> DataFrame:
    """(by, i, j, c) for i <= j, dimensions from 0: covariance of the features in each group; null with `ddof` rows or fewer."""
    first = finite_rows(rows, features).select(features).first()
    sums = moments(rows, by, features, None if first is None else np.array(first[0], float))
    n = sums.where("j = 0").select(by, F.col("s").alias("n"))
    mean = sums.where("i = 0 and j > 0").select(by, F.col("j").alias("k"), "s")
    a, b = mean.select(by, F.col("k").alias("i"), F.col("s").alias("si")), mean.select(by, F.col("k").alias("j"), F.col("s").alias("sj"))
    whole = sums.where("i > 0").join(n, by).join(a, [by, "i"]).join(b, [by, "j"])
    c = F.when(F.col("n") > ddof, (F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - ddof))
    return whole.select(by, (F.col("i") - 1).cast("int").alias("i"), (F.col("j") - 1).cast("int").alias("j"), c.alias("c"))


@dataclass
class Components:
    """mean (D,), components as rows (D or fewer, D) by falling variance, variances and the number of rows."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    n: int

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.variances / self.variances.sum())

    @property
    def participation_ratio(self) -> float:
        return float(self.variances.sum() ** 2 / (self.variances**2).sum())

    def n_components(self, share: float) -> int:
        """Components needed to reach a share of the variance; all where it is not reached."""
        return min(int(np.searchsorted(self.cumulative, share)) + 1, len(self.variances))


def fit_components(rows: DataFrame, features: str = "features") -> Components:
    """Principal components of all rows with finite features, covariance with divisor n - 1; at least two rows.

    A component points to where its largest loading (the first of equals) is positive.
    """
    whole = finite_rows(rows, features)
    first = whole.select(features).first()
    if first is None:
        raise ValueError("no row has finite features")
    shift = np.array(first[0], float)
    d = len(shift)

    def products(piece: pa.RecordBatch) -> np.ndarray:
        x = matrix(piece.column(0)) - shift
        x = np.column_stack([np.ones(len(x)), x])
        return (x.T @ x).ravel()

    return _from_moments(summed(whole, [features], (d + 1) ** 2, products).reshape(d + 1, d + 1), shift)


def _from_moments(m: np.ndarray, shift: np.ndarray) -> Components:
    """Components from the products of (1, features - shift)."""
    n, sums, d = int(round(m[0, 0])), m[0, 1:], len(shift)
    if n < 2:
        raise ValueError("components need two rows")
    cov = (m[1:, 1:] - np.outer(sums, sums) / n) / (n - 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    keep = min(n, d)
    values, vectors = np.maximum(values[::-1][:keep], 0.0), vectors[:, ::-1].T[:keep]
    sign = np.sign(vectors[np.arange(keep), np.abs(vectors).argmax(axis=1)])
    return Components(shift + sums / n, vectors * np.where(sign == 0, 1.0, sign)[:, None], values, n)


def _mapped(rows: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows with a list column replaced by f of it; null stays null."""
    at, schema = rows.columns.index(column), ", ".join(f"`{n}` {'array<double>' if n == column else t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                lists = piece.column(at)
                there = np.asarray(lists.is_valid())
                made: list = [None] * len(there)
                if there.any():
                    for k, row in zip(np.flatnonzero(there), f(matrix(lists.drop_null()))):
                        made[k] = row
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())) if i == at else piece.column(i) for i in range(piece.num_columns)], names=piece.schema.names)

    return rows.mapInArrow(run, schema)


def projected(rows: DataFrame, fit: Components, k: int, features: str = "features") -> DataFrame:
    """Rows with their features centred by the fit's mean and projected on its first k components; other columns stay."""
    return _mapped(rows, features, lambda x: (x - fit.mean) @ fit.components[:k].T)


def unprojected(rows: DataFrame, fit: Components, features: str = "features") -> DataFrame:
    """Rows with coordinates on the first components turned back into features."""
    return _mapped(rows, features, lambda x: x @ fit.components[: x.shape[1]] + fit.mean)


def back_projected(states: DataFrame, fit: Components) -> DataFrame:
    """(state, mean, cov) with means of k coordinates as W'mean + m and covariances, k (diagonal) or k x k numbers by rows,
    as the D x D numbers of W' cov W; W holds the first k components."""

    def back(x: np.ndarray) -> np.ndarray:
        k = x.shape[1]
        side = int(round(k**0.5))
        full = states_width != k
        w = fit.components[:states_width]
        return np.array([(w.T @ row.reshape(side, side) @ w if full else (w.T * row) @ w).ravel() for row in x])

    states_width = width_of(states, "mean")
    return _mapped(unprojected(states.select("state", "mean", "cov"), fit, "mean"), "cov", back)


def cleaned(rows: DataFrame, features: str = "features", confounds: str = "confounds", detrend: bool = True, standardise: bool = True) -> DataFrame:
    """(run, tr, features): what a run's mean, linear trend and confounds leave of every feature, scaled to sample deviation 1.

    `rows` has run, tr and two array columns; a run is solved as a whole in one task by least squares, which copes with
    confounds that depend on each other. Missing confound entries count as 0. A feature without any rest is 0; one
    with a missing entry in a run is null there. A run of one TR is all 0. Runs are as long as a recording.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("tr").combine_chunks()
        n = table.num_rows
        c = np.array([[0.0 if v is None or not np.isfinite(v) else v for v in row or []] for row in table.column("confounds").to_pylist()], float).reshape(n, -1)
        x = np.array([[np.nan if v is None else v for v in row] for row in table.column("features").to_pylist()], float)
        t = np.linspace(-1.0, 1.0, n)[:, None] if detrend else np.zeros((n, 0))
        c = c - c.mean(axis=0)
        spread = np.sqrt((c * c).mean(axis=0))
        design = np.column_stack([np.ones(n), t, c / np.where(spread > 0, spread, 1.0)])
        missing = ~np.isfinite(x).all(axis=0)
        y = np.where(missing, 0.0, x)
        size = np.sqrt((y * y).sum(axis=0))
        rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        norm = np.sqrt((rest * rest).sum(axis=0))
        empty = norm <= 1e-10 * np.maximum(size, 1e-300)
        rest[:, empty] = 0.0
        if standardise:
            rest = rest / np.where(empty, 1.0, norm / np.sqrt(max(n - 1, 1)))
        made = [[None if m else float(v) for v, m in zip(row, missing)] for row in rest]
        return pa.table({"run": table.column("run"), "tr": table.column("tr"), "features": pa.array(made, pa.list_(pa.float64()))})

    held = rows.select(F.col("run").cast("long").alias("run"), F.col("tr").cast("int").alias("tr"), F.col(features).cast("array<double>").alias("features"), F.col(confounds).cast("array<double>").alias("confounds"))
    return held.where("features is not null").groupBy("run").applyInArrow(one, "run long, tr int, features array<double>")


def least_squares(rows: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """(by, n, b array, r2): regression of y on an intercept and `xs` in each group, over rows where all are there.

    b holds the intercept first. The products are sums with map-side combine, so a group of any size is one small row
    when it is solved; columns that depend on others get the smallest coefficients. r2 is null where y does not vary.
    """
    whole = rows.where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    # products of deviations from each group's means, which keeps them small
    centres = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate([y, *xs])])
    gaps = [(F.col(c) - F.col(f"_m{i}")).alias(f"_d{i}") for i, c in enumerate([y, *xs])]
    k = len(xs) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    held = whole.join(centres, by).select(*by, *gaps)
    sums = held.groupBy(*by).agg(F.array(*[F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")) for i, j in pairs]).alias("_s")).join(centres, by)
    sums = sums.withColumn("_m", F.array(*[F.col(f"_m{i}") for i in range(k)]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, r2 = [], []
            for s, m in zip(batch.column(len(by) + 1).to_pylist(), batch.column(len(by) + 2).to_pylist()):
                g = np.zeros((k, k))
                for (i, j), v in zip(pairs, s):
                    g[i, j] = g[j, i] = v
                scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
                c = np.linalg.pinv(g[1:, 1:] / np.outer(scale[1:], scale[1:]), rcond=1e-12, hermitian=True) @ (g[1:, 0] / scale[1:]) / scale[1:]
                b.append([m[0] - float(c @ np.array(m[1:]) if k > 1 else 0.0), *map(float, c)])
                r2.append(float(c @ g[1:, 0] / g[0, 0]) if g[0, 0] > 0 else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(by) + 1)), pa.array(b, pa.list_(pa.float64())), pa.array(r2, pa.float64())], names=[*by, "n", "b", "r2"])

    types = dict(sums.dtypes)
    return sums.select(*by, "n", "_s", "_m").mapInArrow(solve, ", ".join(f"`{c}` {types[c]}" for c in by) + ", n long, b array<double>, r2 double")


def least_squares_residual(rows: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """Adds residual: y less its regression on `xs` in its group; null where one of them is missing."""
    fit = least_squares(rows, y, xs, by).select(*by, F.col("b").alias("_b"))
    line: Column = F.col("_b")[0]
    for i, c in enumerate(xs):
        line = line + F.col("_b")[i + 1] * F.col(c)
    return rows.join(fit, by, "left").withColumn("residual", F.col(y) - line).drop("_b")


def parcel_means(rows: DataFrame, parcels: list[int | None], features: str = "features") -> DataFrame:
    """Rows with the mean of the features of each parcel, at the parcel's number; numbers without a feature are 0.

    `parcels` gives every feature's parcel number, None for features outside all parcels. Its length is the width.
    """
    held = [(i, p) for i, p in enumerate(parcels) if p is not None]
    weights = np.zeros((len(parcels), max((p for _, p in held), default=-1) + 1))
    for i, p in held:
        weights[i, p] = 1.0
    weights /= np.maximum(weights.sum(axis=0), 1.0)
    return _mapped(rows, features, lambda x: x @ weights)


def residual_variance(fit: Components, k: int) -> np.ndarray:
    """(D, 3): each feature's variance in the first k components, in the others, and the others' share (0 without variance)."""
    own = fit.components**2 * fit.variances[:, None]
    signal, rest = own[:k].sum(axis=0), own[k:].sum(axis=0)
    return np.column_stack([signal, rest, np.divide(rest, signal + rest, out=np.zeros(len(rest)), where=signal + rest > 0)])


def components_without(rows: DataFrame, by: str, features: str = "features") -> dict[int, Components]:
    """Components of all rows but those of each value of `by`, by taking its moments away from the sum of all; values that
    leave fewer than two rows have none. The moments of every value pass the driver, so values are seasons or so, not runs."""
    first = finite_rows(rows, features).select(features).first()
    if first is None:
        return {}
    shift = np.array(first[0], float)
    held: dict[int, np.ndarray] = {}
    for r in moments(rows, by, features, shift).toLocalIterator():
        m = held.setdefault(r[by], np.zeros((len(shift) + 1,) * 2))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    total = sum(held.values())
    left = {key: total - m for key, m in held.items()}
    return {key: _from_moments(m, shift) for key, m in left.items() if m[0, 0] > 1.5}


def residual_stability(rows: DataFrame, by: str, k: int, features: str = "features") -> list[tuple[int, float, float, float, float]]:
    """(feature, share, mean, deviation, variation): the residual share with all rows and, over fits without each value of
    `by`, its mean, population deviation and their ratio (0 for a mean under 1e-8)."""
    whole = residual_variance(fit_components(rows, features), k)[:, 2]
    left = np.array([residual_variance(c, min(k, len(c.variances)))[:, 2] for _, c in sorted(components_without(rows, by, features).items())])
    mean, spread = left.mean(axis=0), left.std(axis=0)
    ratio = np.divide(spread, mean, out=np.zeros(len(mean)), where=mean > 1e-8)
    return [(i, *map(float, v)) for i, v in enumerate(zip(whole, mean, spread, ratio))]


def collapsed(maps: DataFrame, networks: DataFrame) -> DataFrame:
    """(state, dim, value) with every value replaced by the mean over its network (dim, network); dims without a network stay out."""
    held = maps.join(networks, "dim")
    mean = held.groupBy("state", "network").agg(F.avg("value").alias("_m"))
    return held.join(mean, ["state", "network"]).select("state", "dim", F.col("_m").alias("value"))


def centred_maps(maps: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(state, dim, value) less the mean over the states of every dim; only dims in `scope` (dim), if given."""
    held = maps if scope is None else maps.join(scope.select("dim").distinct(), "dim", "left_semi")
    mean = held.groupBy("dim").agg(F.avg("value").alias("_m"))
    return held.join(mean, "dim").select("state", "dim", (F.col("value") - F.col("_m")).alias("value"))


def without_components(rows: DataFrame, fit: Components, k: int, features: str = "features") -> DataFrame:
    """Rows whose features have lost their part along the fit's first k components (the mean stays as it is)."""
    v = fit.components[:k]
    return _mapped(rows, features, lambda x: x - (x @ v.T) @ v)

"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

A block of random directions, wider than what is asked by an oversampling, is driven through the covariance by repeated
passes over all centred rows; between passes it is made orthonormal. Every pass also gives the Ritz pairs of the
block and their residuals. Where residuals, held against the gaps of the spectrum, do not fall far enough in the passes
allowed, the block grows to the full dimension, in which Rayleigh-Ritz is exact.

A pass runs on executors: a task centres its rows, multiplies them with the block and hands on one d x l sum, which Spark
adds up. The driver holds d x l numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import row_chunks, table, written
from strandline.llm.topk import quantised

LONG = np.iinfo(np.int64).max


@dataclass
class Whitening:
    """n distinct vectors, their sums (d,), components (d, k) with eigenvalues (k,), the trace and passes over the rows; `full` where the block grew to d."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    full: bool

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, k) whitened coordinates of integer rows; 0 along a component without variance."""
        live = self.values > 0
        scale = np.divide(1.0, np.sqrt(np.where(live, self.values, 1.0)), where=live, out=np.zeros(len(live)))
        return (x - self.sums / self.n) @ self.components * scale

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of (n * x - S) squared; beyond 64 bits an OverflowError."""
        if not x.size:
            return np.zeros(len(x), np.int64)
        most = self.n * int(np.abs(x).max()) + int(np.abs(self.sums).max())
        if most * most * x.shape[1] <= LONG:
            gap = self.n * x - self.sums
            return (gap * gap).sum(axis=1)
        exact = [sum((self.n * int(a) - int(s)) ** 2 for a, s in zip(row, self.sums)) for row in x]
        if max(exact) > LONG:
            raise OverflowError("a squared deviation does not fit 64 bits")
        return np.array(exact, np.int64)


def _rows(batch: pa.RecordBatch, column: str = "q") -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, shape: tuple[int, int], f, exact: bool = False) -> np.ndarray:
    """The sum over all rows of f(x) (x: integer rows, as doubles unless `exact`; f: a `shape` array); one partial sum a task, added up by Spark."""
    held, kind = (np.int64, "long") if exact else (np.float64, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, held)
        for batch in batches:
            for part in row_chunks([batch], 4096):
                total += f(_rows(part).astype(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), *map(pa.array, total.T.copy())], names=["i", *[f"c{j}" for j in range(shape[1])]])

    columns = [f"c{j}" for j in range(shape[1])]
    parts = rows.select("q").mapInArrow(run, "i int, " + ", ".join(f"{c} {kind}" for c in columns))
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # d rows of l numbers
    out = np.zeros(shape, held)
    for r in got:
        out[r["i"]] = r[1:]
    return out


def fit_whitening(vectors: DataFrame, k: int = 4, oversample: int = 8, max_passes: int = 6, tolerance: float = 1e-11, seed: int = 11) -> Whitening | None:
    """Components of the distinct integer vectors `q` of `vectors`, all of one width; None where there are none.

    `vectors` should be a written table that holds each vector once. `tolerance` bounds residual / gap of the first k
    Ritz pairs, which bounds the angle to the true components; equal eigenvalues have no gap, so they always lead to
    the full dimension.
    """
    first = vectors.select(F.size("q").alias("d")).first()
    if first is None:
        return None
    n, d = vectors.count(), first["d"]
    sums = _summed(vectors, (d, 1), lambda x: x.sum(axis=0)[:, None], exact=True)[:, 0]
    mean = sums / n

    def times(block: np.ndarray) -> np.ndarray:
        """Covariance times `block`, and in the last column each dimension's variance."""
        both = _summed(vectors, (d, block.shape[1] + 1), lambda x: np.column_stack([(c := x - mean).T @ (c @ block), (c * c).sum(axis=0)]))
        return both / n

    def ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        small = block.T @ image
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        return e, block @ w, np.linalg.norm(image @ w - block @ w * e, axis=0)

    asked, passes = min(k, d), 0
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + oversample))))[0]
    full = block.shape[1] == d
    while True:
        image, passes = times(block), passes + 1
        trace, image = float(image[:, -1].sum()), image[:, :-1]
        e, u, rest = ritz(block, image)
        floor = d * np.finfo(float).eps * max(trace, 0.0)
        if full:
            break
        near = np.abs(np.diff(e[: asked + 1]))
        gap = np.minimum(np.r_[np.inf, near[:-1]], near)
        if (rest[:asked] <= tolerance * gap).all():
            break
        if passes > max_passes:
            block, full = np.linalg.qr(np.column_stack([u, np.random.default_rng(seed + 1).standard_normal((d, d - u.shape[1]))]))[0], True
        else:
            block = np.linalg.qr(image)[0]
    values = np.where(e[:asked] > floor, e[:asked], 0.0)
    return Whitening(n, sums, u[:, :asked], values, trace, passes, full)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.project(x)[:, live]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _summed(vectors, (len(live) + 1, len(live)), moments) / model.n
    centre = total[-1]
    return float(np.abs(total[:-1] - np.outer(centre, centre) - np.eye(len(live))).max())


def whiten(rows: DataFrame, k: int = 4, oversample: int = 8, max_passes: int = 6) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained, identity_error) for rows of vec_id and q (array<long>).

    Every row is returned for up to k components (fewer where vectors are narrower), repeated rows and rows without an
    id too; the fit takes each distinct vector once, so a vector that a third of all rows repeat weighs as one. Rows
    without a vector are left out. All vectors must have one width; should several come, the most frequent one among
    distinct vectors (of equals the widest) is whitened and the others are left out. A component without variance (a
    single vector, or fewer dimensions spanned than asked) has whitened 0, explained 0 and no part in identity_error.
    Equal eigenvalues: any orthonormal choice among them. No rows give no rows; other columns are not read.
    """
    there = rows.where("q is not null and size(q) > 0").select("vec_id", "q")
    fit = written(there.select("q").dropDuplicates(["q"]), "whitening-vectors")
    widths = fit.groupBy(F.size("q").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    width = widths[0]["w"] if widths else 0
    fit = fit.where(F.size("q") == width)
    model = fit_whitening(fit, k, oversample, max_passes)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, count = identity_error(fit, model), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches, 8192):
            x = _rows(part)
            m = len(x)
            row = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, model.n)), pa.array(model.deviations(x)[row]),
                    pa.array(model.project(x.astype(np.float64)).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return there.where(F.size("q") == width).mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(quantised(table(spark, sf_dir, "embeddings"), 256.0))

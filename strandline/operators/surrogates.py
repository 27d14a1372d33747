"""Surrogate state maps by random rotations, and the test of matched states between participants against them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.matching import assign


def random_rotation(n: int, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix without any preferred direction."""
    q, r = np.linalg.qr(rng.standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def mixed_states(maps: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """States by features: every new map mixes all of them, so that the mean map and the scatter over features stay."""
    k, mean = len(maps), maps.mean(axis=0)
    if k < 2:
        return maps.copy()
    basis = np.linalg.qr(np.column_stack([np.ones(k), np.eye(k)[:, 1:]]))[0][:, 1:]  # what is orthogonal to the mean
    return mean + basis @ random_rotation(k - 1, rng) @ basis.T @ (maps - mean)


def rotated_configuration(maps: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The maps' deviations turned within the space they span: products of maps stay, directions do not."""
    mean = maps.mean(axis=0)
    u, s, v = np.linalg.svd(maps - mean, full_matrices=False)
    r = int((s > s.max(initial=0) * 1e-10).sum())
    return mean + (u[:, :r] * s[:r]) @ random_rotation(r, rng) @ v[:r] if r else maps.copy()


def rotated_blocks(coordinates: np.ndarray, rng: np.random.Generator, block: int = 5) -> np.ndarray:
    """Coordinates on components turned within blocks of neighbouring components, whose lengths stay."""
    out = coordinates.copy()
    for at in range(0, coordinates.shape[1], block):
        out[:, at : at + block] = coordinates[:, at : at + block] @ random_rotation(coordinates[:, at : at + block].shape[1], rng)
    return out


KINDS = {"state_mixing": mixed_states, "configuration": rotated_configuration}


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of every row of a with every row of b; 0 for a row that does not vary."""
    scaled = []
    for x in (a, b):
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        scaled.append(np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12))
    return scaled[0] @ scaled[1].T


def matched_draws(maps: DataFrame, pairs: DataFrame, n_draws: int, seed: int, kind: str = "state_mixing", chunk: int = 20) -> DataFrame:
    """(pair, draw from 0, n_matched, median_r, max_r) of the best one-to-one matching of two participants' states.

    `maps` has subject, state and map (array), `pairs` pair (a number), a and b (subjects). Draw 0 is the data; even draws turn
    b's maps, odd ones a's. A pair with a chunk of draws is a unit of work, so it holds two participants' states only.
    """
    turn = KINDS[kind]
    chunks = F.explode(F.sequence(F.lit(0), F.lit(n_draws // chunk))).alias("chunk")
    side = lambda c: maps.select(F.col("subject").alias(c), "state", "map").join(pairs.select("pair", c), c).select("pair", F.lit(c).alias("side"), "state", "map")
    rows = side("a").unionByName(side("b")).select("*", chunks)
    spark = maps.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "pair", "chunk")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pair, at = int(key[0]), int(key[1])
        a, b = (np.array(part[part["side"] == s].sort_values("state")["map"].tolist(), float) for s in "ab")
        out = []
        for draw in range(at * chunk, min((at + 1) * chunk, n_draws + 1)):
            rng = np.random.default_rng([seed, pair, draw])
            if len(a) and len(b):
                r = correlations(turn(a, rng) if draw and draw % 2 else a, turn(b, rng) if draw and not draw % 2 else b)
                i, j = assign(1 - r)
                out.append((pair, draw, len(i), float(np.median(r[i, j])), float(r[i, j].max())))
        return pd.DataFrame(out, columns=["pair", "draw", "n_matched", "median_r", "max_r"])

    return rows.groupBy("pair", "chunk").applyInPandas(run, "pair long, draw int, n_matched int, median_r double, max_r double")


def matching_test(maps: DataFrame, pairs: DataFrame, n_draws: int, seed: int, kind: str = "state_mixing") -> DataFrame:
    """(pair, n_matched, median_r, null_mean, p, p_family): each pair's median matched correlation against its own draws, and
    against the largest median of all pairs in each draw; the data count among the draws. Pairs with an empty side do not appear."""
    drawn = matched_draws(maps, pairs, n_draws, seed, kind)
    seen = drawn.where("draw = 0").select("pair", "n_matched", "median_r")
    null = drawn.where("draw > 0").select("pair", "draw", F.col("median_r").alias("null"))
    top = null.groupBy("draw").agg(F.max("null").alias("top"))
    met = null.join(top, "draw").join(seen, "pair").groupBy("pair", "n_matched", "median_r").agg(
        F.avg("null").alias("null_mean"), F.sum((F.col("null") >= F.col("median_r") - 1e-12).cast("long")).alias("b"), F.sum((F.col("top") >= F.col("median_r") - 1e-12).cast("long")).alias("f")
    )
    return met.select("pair", "n_matched", "median_r", "null_mean", ((F.col("b") + 1) / (n_draws + 1)).alias("p"), ((F.col("f") + 1) / (n_draws + 1)).alias("p_family"))

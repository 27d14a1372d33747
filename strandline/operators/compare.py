"""Two sets of fits: are pairs across the sets worse than pairs within them?"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.nulls import unranked


def _long(rows: DataFrame, worse: dict[str, str], *keys: str) -> DataFrame:
    """(keys, metric, value); a value that is null or not finite is an error."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in worse])).alias("z")
    long = rows.select(*keys, cells).select(*keys, "z.*")
    strange = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return long.withColumn("value", F.when(strange, F.raise_error(F.concat_ws(" ", F.lit("no finite value:"), F.col("metric"))).cast("double")).otherwise(F.col("value")))


def moved(cross: DataFrame, within: DataFrame, worse: dict[str, str]) -> DataFrame:
    """(metric, cross, within_min, within_median, within_max, outside, moved): does the pair of the two chosen fits lie beyond all pairs
    within the sets?

    `cross` has one row and `within` a row a pair, both with a column a metric; `worse` says for each metric whether 'lower' or
    'higher' is worse. outside: worse than the worst pair within; moved: any metric is outside. No pair within gives no row.
    """
    low = F.array(*[F.lit(m) for m, w in worse.items() if w == "lower"]).cast("array<string>")
    spread = _long(within, worse).groupBy("metric").agg(F.min("value").alias("within_min"), F.percentile("value", 0.5).alias("within_median"), F.max("value").alias("within_max"))
    both = _long(cross, worse).select("metric", F.col("value").alias("cross")).join(spread, "metric")
    outside = F.when(F.array_contains(low, F.col("metric")), F.col("cross") < F.col("within_min")).otherwise(F.col("cross") > F.col("within_max"))
    return both.withColumn("outside", outside).withColumn("moved", F.max("outside").over(Window.partitionBy(F.lit(1))))  # a row a metric


def split_test(pairs: DataFrame, fits: DataFrame, worse: dict[str, str], max_exact: int = 200_000, n_random: int = 20_000, seed: int = 0) -> DataFrame:
    """(metric, statistic, within_median, cross_median, n_splits, exact, p): permutation of the sets over whole fits.

    `fits` has fit and a (boolean), `pairs` i, j (each pair of fits once) and a column a metric. The statistic is the median of pairs within
    the sets less that of pairs across, turned so that larger means worse across. All choices of as many fits are gone through
    where they are at most `max_exact`, as a range of ranks that tasks unrank; else `n_random` draws and the data. p is
    the share of splits whose statistic is at least the data's. A missing pair or a value that is not finite is an error.

    The metrics of all pairs of fits go along to the tasks: fits are seeds of two settings, so they are few.
    """
    spark = pairs.sparkSession
    held = {r["fit"]: bool(r["a"]) for r in fits.select("fit", "a").collect()}  # a row a fit
    names, n = sorted(held), len(held)
    at = {f: x for x, f in enumerate(names)}
    observed = np.array([held[f] for f in names], bool)
    k = int(observed.sum())
    schema = "metric string, statistic double, within_median double, cross_median double, n_splits long, exact boolean, p double"
    if not 0 < k < n or n < 3:
        return spark.createDataFrame([], schema)
    values = {m: np.full((n, n), np.nan) for m in worse}
    for r in _long(pairs, worse, "i", "j").collect():  # pairs of fits
        i, j = sorted((at[r["i"]], at[r["j"]]))
        values[r["metric"]][i, j] = r["value"]
    left, right = np.triu_indices(n, 1)
    flat = {m: v[left, right] for m, v in values.items()}
    if any(np.isnan(v).any() for v in flat.values()):
        raise ValueError("a pair of fits is missing")
    metrics = list(worse)
    sign = np.array([1.0 if worse[m] == "lower" else -1.0 for m in metrics])

    def medians(masks: np.ndarray) -> np.ndarray:
        """(splits, metrics, 2): medians within and across."""
        same = masks[:, left] == masks[:, right]
        return np.stack([np.stack([np.nanmedian(np.where(s, flat[m], np.nan), axis=1) for s in (same, ~same)], axis=1) for m in metrics], axis=1)

    first = medians(observed[None])[0]
    seen = (first[:, 0] - first[:, 1]) * sign
    exact = comb(n, k) <= max_exact
    total = comb(n, k) if exact else n_random + 1

    def drawn(at: int) -> np.ndarray:
        mask = observed.copy()
        if at:
            mask[:] = False
            mask[np.random.default_rng([seed, at]).choice(n, k, replace=False)] = True
        return mask

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(metrics), np.int64)
        for batch in batches:
            for x in range(0, batch.num_rows, 2000):
                ranks = batch.column(0).slice(x, 2000).to_numpy()
                masks = unranked(ranks, n, k).astype(bool) if exact else np.stack([drawn(int(r)) for r in ranks])
                got = medians(masks)
                count += ((got[:, :, 0] - got[:, :, 1]) * sign >= seen - 1e-12).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(metrics, pa.string()), pa.array(count)], names=["metric", "b"])

    beyonds = spark.range(total).mapInArrow(beyond, "metric string, b long").groupBy("metric").agg((F.sum("b") / total).alias("p"))
    table = spark.createDataFrame([(m, float(s), float(w), float(c), total, exact) for m, s, (w, c) in zip(metrics, seen, first)], schema.rsplit(",", 1)[0])
    return table.join(beyonds, "metric")

"""Exact top-k by integer inner product with pivot-table elimination.

|q - c| >= |d(q, p) - d(c, p)| for every pivot p, and q.c = (|q|^2 + |c|^2 - |q - c|^2) / 2, so the largest lower
bound over many pivots gives an upper bound of the score. Queries and rows meet on executors in groups of bounded size.
In a group the rows lie in cells by their nearest pivot; the pivot table holds each cell's smallest and largest distance
to every pivot, and cells are evaluated in order of their bound until it falls below the k-th best score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import group_bounds, shuffle_parts, sorted_runs, table, written

EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: float = 64.0, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, q array<long>) with floor(scale * x) of every component; rows with a null or non-finite one are left out."""
    v = F.col(vector)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("q"))


def _products(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as int64; `exact`: all of them are exact in doubles, in which `rows` then comes."""
    return (queries.astype(np.float64) @ rows.T).astype(np.int64) if exact else queries @ rows.T


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def search_group(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, cell: int = 256, together: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of the k best rows of the group for each query, by pivot elimination.

    A cell is left out for a query only if its bound is below a score that k rows reach, so ties at the k-th score
    survive. `together` queries with near pivots share the order of their cells.
    """
    f, g = rows.astype(np.float64), queries.astype(np.float64)
    exact = float(np.abs(g).max(initial=0)) * float(np.abs(f).max(initial=0)) * rows.shape[1] < EXACT
    to_c, to_q = _distances(f, pivots), _distances(g, pivots)
    order = np.lexsort((to_c.min(axis=1, initial=np.inf), to_c.argmin(axis=1))) if len(pivots) else np.arange(len(rows))
    ids, f, to_c = ids[order], f[order], to_c[order]
    held = f if exact else rows[order]
    norm_c, norm_q = (f * f).sum(axis=1), (g * g).sum(axis=1)
    starts = np.arange(0, len(ids), cell)
    low, high, top = np.minimum.reduceat(to_c, starts), np.maximum.reduceat(to_c, starts), np.maximum.reduceat(norm_c, starts)
    slack = 1e-6 * (1 + norm_c.max(initial=0) + norm_q.max(initial=0))
    never = np.iinfo(np.int64).min
    by_pivot = to_q.argmin(axis=1).argsort(kind="stable") if len(pivots) else np.arange(len(qids))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(qids), together):
        part = by_pivot[s : s + together]
        gap = np.zeros((len(part), len(starts)))
        for p in range(len(pivots)):
            np.maximum(gap, to_q[part, p, None] - high[:, p], out=gap)
            np.maximum(gap, low[:, p] - to_q[part, p, None], out=gap)
        bound = (norm_q[part, None] + top - gap * gap) / 2 + slack
        best = np.full((len(part), k), never)
        most = bound.max(axis=0)
        for c in np.argsort(-most):
            floor = best.min(axis=1)
            if most[c] < floor.min():
                break
            live = np.flatnonzero(bound[:, c] >= floor)
            if not len(live):
                continue
            at = slice(starts[c], starts[c] + cell)
            score = _products(queries[part[live]], held[at], exact)
            score[ids[at] == qids[part[live], None]] = never
            both = np.concatenate([best[live], score], axis=1)
            best[live] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            r, i = np.nonzero((score >= best[live].min(axis=1)[:, None]) & (score > never))
            found.append((part[live[r]], ids[at][i], score[r, i]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return _best(*(np.concatenate([x[i] for x in found]) for i in range(3)), k)


def _best(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, qi))
    qi, ids, scores = qi[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, np.int64)
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
    keep = rank < k
    return qi[keep], ids[keep], scores[keep]


def exact_topk(rows: DataFrame, queries: DataFrame, k: int = 20, n_pivots: int = 32, query_group: int = 2048, row_group: int = 65536) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k rows of highest integer inner product for every query but itself.

    `rows` and `queries` have vec_id and q (array<long>). Both fall into groups of about `row_group` and `query_group`
    by a hash of their id; every query group meets every row group in one task, which holds no more than the two, and
    keeps k a query; these meet by query. Nothing but the pivots, `n_pivots` rows of smallest hashed id that steer
    speed and not results, passes the driver. Vectors of unequal width do not meet; rows without an id or a vector
    take no part; a query that comes twice with one vector is asked once, with two vectors twice. Fewer than k
    candidates: all of them. Ties go to the smaller vec_id; repeated rows count each; an empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = written(rows.where("vec_id is not null and q is not null").select("vec_id", "q"), "topk-rows")
    asked = queries.where("vec_id is not null and q is not null").select("vec_id", "q").dropDuplicates(["vec_id", "q"])
    head = rows.select("q", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(n_pivots).collect()
    pivots: dict[int, np.ndarray] = {}
    for width in {len(r["q"]) for r in head}:
        pivots[width] = np.array([r["q"] for r in head if len(r["q"]) == width], np.float64).reshape(-1, width)
    n_rows, n_asked = rows.count(), asked.count()
    across = max(1, -(-n_asked // query_group))
    down = max(1, -(-n_rows // row_group), min(-(-n_rows // 1024), -(-2 * spark.sparkContext.defaultParallelism // across)))
    part = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(part(1, across).alias("c"), every(down).alias("r"), F.lit(0).alias("side"), "vec_id", "q")
    right = rows.select(every(across).alias("c"), part(2, down).alias("r"), F.lit(1).alias("side"), "vec_id", "q")
    met = left.unionByName(right).withColumn("meeting", (F.col("r") * across + F.col("c")) * (1 << 20) + F.size("q"))
    met = met.repartition(max(shuffle_parts(spark), min(across * down, 20_000)), "meeting").sortWithinPartitions("meeting", "side").select("meeting", "side", "vec_id", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sorted_runs(batches, "meeting", 1):
            whole = whole.combine_chunks()
            keys, side, ids = (whole.column(n).to_numpy() for n in ("meeting", "side", "vec_id"))
            lists = whole.column("q").chunk(0)
            for s, size in zip(*group_bounds(keys)):
                n = int(np.searchsorted(side[s : s + size], 1))
                if n == 0 or n == size:
                    continue
                own = lists.slice(s, size)
                x = own.flatten().to_numpy().reshape(size, int(keys[s]) & ((1 << 20) - 1))
                qi, found, score = search_group(ids[s + n : s + size], x[n:], ids[s : s + n], x[:n], pivots.get(x.shape[1], np.zeros((0, x.shape[1]))), k)
                which = pa.array(s + qi)
                yield pa.RecordBatch.from_arrays([whole.column("vec_id").chunk(0).take(which), pa.array(_row_hash(x[:n])[qi]), pa.array(found), pa.array(score)], names=["query_id", "vector", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vector long, vec_id long, score long")
    by = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _row_hash(x: np.ndarray) -> np.ndarray:
    """A number for each row that tells the vectors of one id apart."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in np.ascontiguousarray(x)], np.uint64).view(np.int64)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return exact_topk(rows, rows.where("vec_id % 20 = 0"))

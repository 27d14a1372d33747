"""Embedding near-duplicates: random projections decoded to E8 lattice cells, neighbouring cells probed, cosine verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.blocks import dealt_buckets
from strandline.llm.common import group_bounds, row_chunks, sorted_runs, table, written
from strandline.llm.components import connected_components


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead from a cell to its neighbours."""
    whole = [[a if n == i else b if n == j else 0.0 for n in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1.0, -1.0), repeat=2)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and where the sum is odd round the worst component the other way."""
    near = np.rint(x)
    error = x - near
    worst = np.abs(error).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[rows, worst[rows]] += np.where(error[rows, worst[rows]] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the even integer points and of those shifted by a half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cell_keys(unit: np.ndarray, labels: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) int64 keys: the home cell, then the neighbours that lie closest to the projection."""
    rng = np.random.default_rng(seed)
    roots = e8_roots()
    out = np.zeros((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        x = unit @ (rng.normal(size=(unit.shape[1], 8)) * scale)
        weights = rng.integers(1, 1 << 62, 8, dtype=np.int64) | 1
        home = decode_e8(x)
        side = (x - home) @ roots.T
        top = np.argsort(-side, axis=1, kind="stable")[:, :probes]
        cells = np.concatenate([home[:, None], home[:, None] + roots[top]], axis=1)
        key = (np.rint(2 * cells).astype(np.int64) * weights).sum(axis=2)
        key ^= (labels[:, None] * np.int64(0x5851F42D4C957F2D)) + np.int64(t) * np.int64(0x14057B7EF767814F)
        out[:, t] = key ^ ((key >> 29) * np.int64(0x1B873593))
    return out


def _usable(v) -> F.Column:
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & whole & F.exists(v, lambda x: x != 0)


def _group() -> F.Column:
    """A number for the label, whatever its kind."""
    return F.xxhash64(F.col("label").cast("string"))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """One row for each distinct (label, embedding) that takes part: rep (smallest vec_id), copies, label, embedding, c."""
    taking = vectors.where(F.col("label").isNotNull() & _usable(F.col("embedding")))
    return taking.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def _keyed(classes: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 1024):
            rep, copies, label = (batch.column(i) for i in range(3))
            lists = batch.column(3)
            width = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(np.float64)
            ends = np.cumsum(width)
            keys = np.zeros((batch.num_rows, tables, 1 + probes), np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x = flat[(ends[at] - w)[:, None] + np.arange(w)]
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys[at] = cell_keys(x, label.to_numpy()[at] * 65537 + int(w), tables, probes, scale, seed)
            each = keys.reshape(batch.num_rows, -1)
            held = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * each.shape[1]), pa.array(each.ravel()))
            yield pa.RecordBatch.from_arrays([rep, copies, label, lists, held], names=["rep", "copies", "label", "embedding", "keys"])

    kind = dict(classes.dtypes)["embedding"]
    rows = classes.select("rep", "copies", _group().alias("label"), "embedding")
    return rows.mapInArrow(run, f"rep long, copies long, label long, embedding {kind}, keys array<long>")


def _verified(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of unit rows with cosine of `least` or more."""
    i_all, j_all = [], []
    for s in range(0, len(x), 256):
        i, j = np.nonzero(x[s : s + 256] @ x[s:].T >= least)
        keep = j > i
        i_all.append(i[keep] + s)
        j_all.append(j[keep] + s)
    return np.concatenate(i_all), np.concatenate(j_all)


def _meet(ka: np.ndarray, kb: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a's home is among b's cells of table t, and b's home among a's."""
    return (kb[:, t] == ka[:, t, :1]).any(axis=1), (ka[:, t] == kb[:, t, :1]).any(axis=1)


def _group_links(bucket: int, t: int, rep, copies, own, one_block, x, keys, least):
    """(rep, links) sums and forest edges of one task group; a pair counts in the first table and cell where it meets."""
    i, j = _verified(x, least)
    if not len(i):
        return None
    swap = rep[i] > rep[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    valid = (own[i] != own[j]) | one_block
    i, j = i[valid], j[valid]
    forward, back = _meet(keys[i], keys[j], t)
    cell = np.where(forward, keys[i, t, 0], keys[j, t, 0])
    first = (forward | back) & (cell == bucket)
    i, j = i[first], j[first]
    for earlier in range(t):
        fresh = ~np.logical_or(*_meet(keys[i], keys[j], earlier))
        i, j = i[fresh], j[fresh]
    if not len(i):
        return None
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    label = np.arange(len(rep))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    on = np.flatnonzero(links)
    tied = np.flatnonzero(label != np.arange(len(rep)))
    return rep[on], links[on], rep[label[tied]], rep[tied]


def _links(keyed: DataFrame, tables: int, probes: int, least: float, block_rows: int) -> DataFrame:
    """(a, b, n): links n of class a where b is null, else a forest edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sorted_runs(batches, "task", 16384):
            whole = whole.combine_chunks()
            col = {n: whole.column(n).to_numpy() for n in ("task", "bucket", "t", "own_block", "block_a", "block_b", "rep", "copies", "label")}
            keys = whole.column("keys").chunk(0).flatten().to_numpy().reshape(whole.num_rows, tables, 1 + probes)
            lists = whole.column("embedding").chunk(0)
            width, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.float64)
            ends = np.cumsum(width)
            a, b, n = [], [], []
            for s, size in zip(*group_bounds(col["task"])):
                part = slice(s, s + size)
                if size < 2 or len(np.unique(width[part])) != 1 or len(np.unique(col["label"][part])) != 1:
                    continue
                x = flat[ends[s] - width[s] : ends[s + size - 1]].reshape(size, -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                got = _group_links(col["bucket"][s], int(col["t"][s]), col["rep"][part], col["copies"][part], col["own_block"][part], col["block_a"][s] == col["block_b"][s], x, keys[part], least)
                if got is not None:
                    a += [got[0], got[2]]
                    n += [got[1], np.zeros(len(got[2]), np.int64)]
                    b += [np.full(len(got[0]), -1), got[3]]
            if a:
                b_all = np.concatenate(b)
                is_edge = np.concatenate([np.r_[np.zeros(len(x), bool)] if k % 2 == 0 else np.ones(len(x), bool) for k, x in enumerate(a)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(b_all, mask=~is_edge), pa.array(np.concatenate(n))], names=["a", "b", "n"])

    cells = keyed.select("rep", F.posexplode("keys").alias("place", "bucket"))
    cells = cells.withColumn("t", F.floor(F.col("place") / (1 + probes)).cast("int")).drop("place")
    met = dealt_buckets(cells, "bucket", "rep", block_rows, payload=keyed.select("rep", "copies", "label", "embedding", "keys"))
    return met.select("task", "bucket", "t", "own_block", "block_a", "block_b", "rep", "copies", "label", "embedding", "keys").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.93, tables: int = 6, probes: int = 2, scale: float = 0.6, seed: int = 11, block_rows: int = 1024) -> DataFrame:
    """One row for each input row: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and the cosine is at least `least`; pairs are looked for in shared or
    neighbouring lattice cells of `tables` projections, then verified in double precision, so no pair below it links
    and recall follows from tables, probes and scale. Equal vectors of a label form one class, which counts its
    copies. Labels may be of any kind that has a text. Vectors that are null, zero or hold null or non-finite components, and rows without label, link with
    nothing. No rows give no rows; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    classes = vector_classes(rows)
    keyed = written(_keyed(classes, tables, probes, scale, seed), "lattice-keys")
    found = written(_links(keyed, tables, probes, least, block_rows), "lattice-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("b is not null").select("a", "b"))
    named = keyed.select("rep", "copies", "label", "embedding").join(links, F.col("rep") == F.col("a"), "left").join(comps, F.col("rep") == F.col("node"), "left")
    named = named.select(
        F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"), F.col("label").alias("g"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"),
    )
    taking = F.col("label").isNotNull() & _usable(F.col("embedding"))
    keyed_rows = rows.select("vec_id", F.when(taking, _group()).alias("g"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    out = keyed_rows.join(named, ["g", "h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

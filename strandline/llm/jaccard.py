"""Near-duplicates by word-shingle Jaccard: min-hash bands propose clusters, exact shingle sets decide inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.blocks import dealt_buckets
from strandline.llm.common import group_bounds, row_chunks, sorted_runs, texts_as_bytes, written
from strandline.llm.components import connected_components


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of all runs of `shingle` words; a shorter text is one shingle, no words give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.unique(np.fromiter([digest(line[i:j]) for i, j in zip(first, ends[shingle - 1 :].tolist())], np.uint64, len(first)))


def band_keys(hashes: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One int64 key a band of `rows` minimum hashes of a shingle set."""
    rng = np.random.default_rng(seed)
    mask, factor, weight = (rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64) for _ in range(3))
    low = np.full(bands * rows, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        mixed = (hashes[i : i + 1024, None] ^ mask) * (factor | np.uint64(1))
        low = np.minimum(low, mixed.min(axis=0))
    return (low * (weight | np.uint64(1))).reshape(bands, rows).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketches(documents: DataFrame, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, h1, h2, keys) of every text that has words; h1 and h2 are the set's 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 2048):
            sets = [shingle_set(t, shingle) for t in texts_as_bytes(batch.column(1))]
            there = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[i].tobytes()) for i in there), np.int64).reshape(-1, 2)
            keys = [band_keys(sets[i], bands, rows, seed) for i in there]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], names=["doc_id", "h1", "h2", "keys"])

    return documents.mapInArrow(run, "doc_id long, h1 long, h2 long, keys array<long>")


def _forest(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the smallest index of its component, where sets with Jaccard of `least` or more link."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    label = np.arange(n)
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own, lo = ids[starts[i] : starts[i] + sizes[i]], starts[i + 1]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[lo:]], starts[i + 1 :] - lo)
        mark[own] = 0
        near = i + 1 + np.flatnonzero(both >= least * (sizes[i] + sizes[i + 1 :] - both) - 1e-9)
        if len(near):
            tied = np.unique(np.r_[label[i], label[near]])
            label[np.isin(label, tied)] = tied[0]
    return label


def _verified(sets: DataFrame, least: float, block_rows: int) -> DataFrame:
    """Links (a, b) that connect what links inside each cluster, all pairs of a cluster being compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sorted_runs(batches, "task", 512):
            keys, rep = whole.column("task").to_numpy(), whole.column("rep").to_numpy()
            held = whole.column("shingles")
            found_a, found_b = [], []
            for s, size in zip(*group_bounds(keys)):
                if size < 2:
                    continue
                root = _forest([np.frombuffer(x, np.uint64) for x in held.slice(s, size).to_pylist()], least)
                at = np.flatnonzero(root != np.arange(size))
                found_a.append(rep[s + root[at]])
                found_b.append(rep[s + at])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return dealt_buckets(sets, "cluster", "rep", block_rows).select("task", "rep", "shingles").mapInArrow(run, "a long, b long")


def jaccard_links(documents: DataFrame, shingle: int = 5, least: float = 0.8, bands: int = 20, rows: int = 5, seed: int = 42, block_rows: int = 512) -> DataFrame:
    """Links (a, b long) between doc_ids of (doc_id, text), whose components are those of all pairs with a shingle-set
    Jaccard of `least` or more that the search meets.

    Texts with equal sets form one class. Classes that share a band key form a cluster, through chains too, and all
    pairs of a cluster are compared exactly: no pair below `least` links, and a pair at 0.8 is missed with a
    probability of at most (1 - 0.8^5)^20 = 0.0004. Rows without doc_id and texts without words link with nothing.
    """
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = written(_sketches(texts, shingle, bands, rows, seed), "jaccard-sketches")
    classes = written(marks.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "jaccard-classes")
    same = marks.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    entries = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    heads = entries.groupBy("band", "key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    clusters = connected_components(entries.join(heads, ["band", "key"]).select("a", F.col("rep").alias("b")).distinct())
    members = texts.join(clusters, F.col("doc_id") == F.col("node")).select(F.col("component").alias("cluster"), F.col("node").alias("rep"), "text").dropDuplicates(["rep", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 2048):
            sets = [shingle_set(t, shingle).tobytes() or None for t in texts_as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["cluster", "rep", "shingles"])

    sets = written(members.mapInArrow(run, "cluster long, rep long, shingles binary").where("shingles is not null"), "jaccard-sets")
    return same.union(_verified(sets, least, block_rows)).distinct()

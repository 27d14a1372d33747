"""SimHash near-duplicates: majority fingerprints, a byte-position inverted index with count filtering, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.blocks import dealt_buckets
from strandline.llm.common import group_bounds, row_chunks, sorted_runs, table, texts_as_bytes, written
from strandline.llm.components import connected_components

BYTES = 8
_BITS = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    hashes = np.fromiter([digest(line[i:j], seed) for i, j in zip(first, ends[shingle - 1 :].tolist())], np.uint64, len(first))
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(((total * 2 > len(hashes)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprints(documents: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of whole texts; a null or wordless text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 2048):
            prints = np.array([fingerprint(t, shingle, seed) for t in texts_as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_triples(positions: int = BYTES) -> list[tuple[int, int, int]]:
    """Byte triples of which every four positions hold at least one.

    The positions stand in three groups on a ring; a triple is chosen if it lies within a group or has two members
    in a group and one in the next group.
    """
    group = [i * 3 // positions for i in range(positions)]
    chosen = []
    for triple in combinations(range(positions), 3):
        count = [sum(group[i] == g for i in triple) for g in range(3)]
        if 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(triple)
    return chosen


def _postings(classes: DataFrame, max_bits: int) -> DataFrame:
    """Inverted index (posting long, fp, rep): one row for each stored combination of positional bytes.

    Two fingerprints that differ in at most `max_bits` bits agree in at least 8 - max_bits bytes. The index holds
    sets of positional bytes such that any that many shared bytes contain one of them.
    """
    need = BYTES - max_bits
    if need < 1:
        raise ValueError("at most 7 differing bits can be guaranteed a shared byte")
    sets = covering_triples() if need == 4 else list(combinations(range(BYTES), need)) if need < 4 else list(combinations(range(BYTES), 4))
    byte = lambda i: F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(255)
    keys = []
    for n, chosen in enumerate(sets):
        value = F.lit(n).cast("long")
        for i in chosen:
            value = F.shiftleft(value, 8).bitwiseOR(byte(i))
        keys.append(value)
    return classes.select("fp", "rep", F.explode(F.array(*keys)).alias("posting"))


def _links(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """True where the pair shares the guaranteed number of positional bytes and then passes the exact bit count."""
    differ = a ^ b
    shared = np.zeros(differ.shape, np.uint8)
    for i in range(BYTES):
        shared += ((differ >> np.uint64(8 * i)) & np.uint64(255)) == 0
    out = shared >= BYTES - max_bits
    out[out] = np.bitwise_count(differ[out]) <= max_bits
    return out


def _forest(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """For each member the smallest member index of its component among these prints."""
    n = len(prints)
    label = np.arange(n)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 128):
        near[i : i + 128] = _links(prints[i : i + 128, None], prints[None, :], max_bits)
    while True:
        low = label.copy()
        for i in range(0, n, 128):
            low[i : i + 128] = np.where(near[i : i + 128], label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_edges(classes: DataFrame, max_bits: int = 4, block_rows: int = 2048) -> DataFrame:
    """Links (a, b) between class representatives, enough to connect all that link directly or by chains in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sorted_runs(batches, "task"):
            keys, rep = whole.column("task").to_numpy(), whole.column("rep").to_numpy()
            prints = whole.column("fp").to_numpy().view(np.uint64)
            starts, sizes = group_bounds(keys)
            found_a, found_b = [], []
            for size in np.unique(sizes[sizes > 1]):
                of = starts[sizes == size]
                if size <= 24:
                    x, y = np.triu_indices(size, 1)
                    i, j = (of[:, None] + x).ravel(), (of[:, None] + y).ravel()
                    keep = _links(prints[i], prints[j], max_bits)
                    found_a.append(rep[i[keep]])
                    found_b.append(rep[j[keep]])
                else:
                    for s in of:
                        root = _forest(prints[s : s + size], max_bits)
                        at = np.flatnonzero(root != np.arange(size))
                        found_a.append(rep[s + root[at]])
                        found_b.append(rep[s + at])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    met = dealt_buckets(_postings(classes, max_bits), "posting", "fp", block_rows)
    return met.select("task", "fp", "rep").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """One row for each input row: doc_id, fp long, fingerprint string, component_id long.

    Equal fingerprints form one class with the smallest doc_id as representative; classes link at `max_bits` or
    fewer differing bits. component_id is the smallest doc_id reachable. Null and empty texts have fingerprint 0 and
    link like any other; repeated rows stay; a row without doc_id takes its class's component; no rows give no rows.
    """
    prints = written(fingerprints(documents, shingle, seed), "simhash-prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    edges = near_edges(classes.where("rep is not null"), max_bits)
    found = connected_components(edges)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # sorted: many copies make the file of fingerprints small, and Spark would send all rows through the driver
    return prints.hint("merge").join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")

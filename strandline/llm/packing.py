"""Best-fit packing of token runs into sequences of fixed capacity.

The plan is made on the histogram of lengths (at most `capacity` counts, whatever the number of documents), and the
rows find their place by their rank among the rows of equal length, which is a count a part and an offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_parts, table, text_or_empty, written
from strandline.llm.tokens import encoded_batches, vocabulary_path

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of equal bins, lengths in a bin) for a histogram of lengths between 1 and `capacity`.

    Lengths over a third of the capacity meet first: from the longest down, a bin takes the longest partner that
    fits, and at most one (two where the bin's own length leaves room for a third large one). Shorter lengths then
    best-fit the gaps, longest first, each into the smallest gap that holds it. Equal bins move as one run with a
    count, so the work depends on the number of distinct lengths and not on that of the rows.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] += n
    third = capacity // 3
    runs: list[tuple[int, int, tuple[int, ...]]] = []  # count, gap, lengths

    def partner(most: int, least: int) -> int:
        there = np.flatnonzero(left[least : most + 1]) if most >= least else []
        return int(there[-1]) + least if len(there) else 0

    for length in range(capacity, third, -1):
        while left[length]:
            got, gap, n = (length,), capacity - length, int(left[length])
            for _ in range(2):
                other = partner(min(gap, length), third + 1)
                if not other:
                    break
                of = got.count(other)
                n = min(n, int(left[other]) // (of + 1) if of or other == length else int(left[other]))
                if other == length and n == 0:
                    n = 1
                    break
                got, gap = (*got, other), gap - other
            for x in got:
                left[x] -= n
            runs.append((n, gap, got))
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n, gap, got in runs:
        gaps.setdefault(gap, []).append((n, got))
    done: list[tuple[int, list[int]]] = []
    for length in range(third, 0, -1):
        while left[length]:
            fit = min((g for g in gaps if g >= length), default=0)
            if not fit:
                n, per = int(left[length]), capacity // length
                full, rest = divmod(n, per)
                if full:
                    gaps.setdefault(capacity - per * length, []).append((full, (length,) * per))
                if rest:
                    gaps.setdefault(capacity - rest * length, []).append((1, (length,) * rest))
                left[length] = 0
                break
            n, got = gaps[fit].pop()
            if not gaps[fit]:
                del gaps[fit]
            per = min(fit // length, int(left[length]))
            use = min(n, int(left[length]) // per)
            if use < n:
                gaps.setdefault(fit, []).append((n - use, got))
            left[length] -= use * per
            gaps.setdefault(fit - per * length, []).append((use, got + (length,) * per))
    for group in gaps.values():
        done += [(n, list(got)) for n, got in group]
    return done


def _slots(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of bins, places a bin, first bin, offset of the first place) by run and length."""
    rank: dict[int, int] = {}
    slots, first = [], 0
    for n, got in sorted(plan, key=lambda x: (-x[1][0], x[1])):
        offset = 0
        for length in sorted(set(got), reverse=True):
            per = got.count(length)
            slots.append((length, rank.get(length, 0), n, per, first, offset))
            rank[length] = rank.get(length, 0) + n * per
            offset += per * length
        first += n
    return slots


def ranked(rows: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """Adds rank0 (long): the place of a row among the rows of equal `key`, from 0, without one task for a hot key.

    Rows fall into parts by a hash of `order`; a part's rows are numbered within it and offset by the counts of the
    parts before it.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(key, "part", (F.sum("n").over(Window.partitionBy(key).orderBy("part")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1)
    return inside.join(before, [key, "part"]).withColumn("rank0", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def best_fit_pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds sequence_id (long) and offset (int) to rows with a `length` of 1 to `capacity`.

    `order` are columns that tell rows apart; rows equal in all of them may change places, which changes nothing.
    An input without rows gives no rows; a length outside the range is an error. `pieces` should be a written table,
    as it is read twice.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    slots = _slots(plan_bins(counts, capacity))
    parts = max(shuffle_parts(spark), 1)
    rows = ranked(pieces, "length", order, parts)
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for length, *slot in slots:
        by_length.setdefault(length, []).append(tuple(slot))
    arrays = {k: np.array(v, np.int64) for k, v in by_length.items()}  # bounded: runs come from at most `capacity` lengths
    at = rows.schema.names.index("length"), rows.schema.names.index("rank0")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at[0]).to_numpy(), batch.column(at[1]).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int32)
            for value in np.unique(length):
                here = np.flatnonzero(length == value)
                slot = arrays[int(value)]
                s = slot[np.searchsorted(slot[:, 0], rank[here], side="right") - 1]
                inner = rank[here] - s[:, 0]
                seq[here] = s[:, 3] + inner // s[:, 2]
                off[here] = s[:, 4] + inner % s[:, 2] * value
            keep = [batch.column(i) for i in range(batch.num_columns) if i != at[1]]
            names = [n for i, n in enumerate(batch.schema.names) if i != at[1]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("rank0").dtypes) + ", sequence_id long, offset int"
    return rows.mapInArrow(place, schema)


def token_pieces(documents: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Token runs of at most `capacity` ids: (doc_id, piece, start, length, ids_crc32).

    A document's ids end with the end id. Only a longer document is cut, into full pieces; its first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, n in encoded_batches(batches, vocabulary, 1):
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            short = (n - (count - 1) * capacity)[row]
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            length = np.where(piece == 0, short, capacity)
            begin = (np.cumsum(n) - n)[row] + start
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[i : i + k]) for i, k in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text")).mapInArrow(run, PIECES)


def pack_documents(documents: DataFrame, vocabulary: str | None = None, capacity: int = 1024) -> DataFrame:
    """Tokenize whole documents, cut the long ones and pack the pieces into sequences.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    end id alone. Repeated rows are packed as often as they come; no rows give no rows; other columns are not read.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    pieces = written(token_pieces(documents, vocabulary, capacity), "pack-pieces")
    packed = best_fit_pack(pieces, capacity, ["doc_id", "piece", "ids_crc32", "start"])
    return packed.withColumn("length", F.col("length").cast("long")).withColumn("offset", F.col("offset").cast("long"))


def sequences(packed: DataFrame, documents: DataFrame, vocabulary: str | None = None, capacity: int = 1024) -> DataFrame:
    """The sequences themselves: (sequence_id, ids array<int>, doc_ids array<long>, starts array<int>) from `packed`."""
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, n in encoded_batches(batches, vocabulary, 1):
            ends = np.cumsum(n)
            rows = [ids[e - k : e].astype(np.int32) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    whole = docs.mapInArrow(run, "doc_id long, ids array<int>").dropDuplicates(["doc_id", "ids"])
    cut = packed.join(whole, "doc_id").select("sequence_id", "doc_id", "offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids"))
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return cut.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.flatten("r.ids").alias("ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").cast("array<int>").alias("starts")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

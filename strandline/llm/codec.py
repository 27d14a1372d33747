"""Token-id files: frequency-ranked ids, one to four bytes each, with the byte counts in separate control bytes.

A page is a control stream (two bits a value, four values a byte) and a data stream (the value's low bytes first).
Frequent ids have small ranks, so most take one byte. Pages stand in rows of a Parquet table in ascending document
order, and numpy decodes them by table lookup on whole pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import row_chunks, shuffle_parts, table, text_or_empty, work_path, written
from strandline.llm.tokens import encoded_batches, vocabulary_path

PAGE = "shard int, page int, doc_ids array<long>, n_tokens array<int>, control binary, data binary"
_SIZES = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first `n` ranks of a page: sizes by table lookup, values by gathered bytes."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = ends - size
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        out |= np.where(size > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def token_rows(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, crc long, ids binary, counts binary): the ids of each whole text with the end id, as little-endian 16 or
    32-bit numbers; each task's last row has null in all columns but counts, its number of each id as 64-bit numbers.
    """
    wide = _id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        names = ["doc_id", "crc", "ids", "counts"]
        for batch, ids, n in encoded_batches(batches, vocabulary, 1):
            got = np.bincount(ids, minlength=len(counts))
            got[: len(counts)] += counts
            counts = got
            raw, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(n) * 4
            crc = [zlib.crc32(raw[i:j]) for i, j in zip((ends - n * 4).tolist(), ends.tolist())]
            data = ids.astype(wide)
            offsets = pa.array(np.r_[0, np.cumsum(n) * data.itemsize].astype(np.int32))
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), binary, pa.nulls(len(n), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()])], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text")).mapInArrow(run, "doc_id long, crc long, ids binary, counts binary")


def _id_width(vocabulary: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def ids_by_frequency(rows: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first, ties by id; at most the vocabulary's size. Adds the tasks' counts up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = np.frombuffer(raw, np.int64)
                total, got = (total, got) if len(total) >= len(got) else (got.copy(), total)
                total[: len(got)] += got
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(total[there])], names=["id", "n"])

    total = rows.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = total.column("id").to_numpy(), total.column("n").to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def write_token_files(documents: DataFrame, path: str, vocabulary: str, page_tokens: int = 1 << 16) -> np.ndarray:
    """Encode all documents in ascending doc_id order to `path`; returns the ids by rank, which are also at path/ranks.

    Null ids come first, equal ids in order of their content's checksum. An input without rows writes empty tables.
    """
    spark = documents.sparkSession
    wide = _id_width(vocabulary)
    rows = written(token_rows(documents, vocabulary), "token-rows")
    by_rank = ids_by_frequency(rows)
    spark.createDataFrame(pa.table({"rank": np.arange(len(by_rank), dtype=np.int64), "id": by_rank.astype(np.int64)})).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, docs, sizes, tokens, shard = 0, [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            control, data = encode_ranks(rank_of[np.frombuffer(b"".join(held), wide)])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([control]), pa.array([data])],
                names=["shard", "page", "doc_ids", "n_tokens", "control", "data"],
            )

        for batch in row_chunks(batches, 1024):
            for shard, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):  # noqa: B007
                held.append(raw)
                docs.append(doc)
                sizes.append(len(raw) // np.dtype(wide).itemsize)
                tokens += sizes[-1]
                if tokens >= page_tokens:
                    yield flush()
                    page, held, docs, sizes, tokens = page + 1, [], [], [], 0
        if docs:
            yield flush()

    placed = rows.where("ids is not null").select("doc_id", "crc", "ids").repartitionByRange(shuffle_parts(spark), "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    placed.select(F.spark_partition_id().alias("shard"), "doc_id", "ids").mapInArrow(run, PAGE).write.option("compression", "zstd").parquet(f"{path}/pages")
    return by_rank


def _decoder(spark: SparkSession, path: str):
    """Function from a batch of pages to (shard, page, doc_ids, sizes, ids) of each of them.

    The rank table has at most the vocabulary's size and goes to the tasks whole.
    """
    ranks = spark.read.parquet(f"{path}/ranks").toArrow()
    by_rank = np.zeros(ranks.num_rows, np.uint32)
    by_rank[ranks.column("rank").to_numpy()] = ranks.column("id").to_numpy()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in row_chunks(batches, 16):
            for shard, page, docs, sizes, control, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                n = np.array(sizes, np.int64)
                yield shard, page, docs, n, by_rank[decode_ranks(control, data, int(n.sum()))]

    return decoded


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/pages").select("shard", "page", "doc_ids", "n_tokens", "control", "data")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents in their order: shard, page, place (in the page), doc_id, first (ids of the page before it), ids."""
    decoded = _decoder(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, page, docs, n, ids in decoded(batches):
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
            same = [pa.array(np.full(len(docs), v, np.int32)) for v in (shard, page)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(docs), dtype=np.int32)), pa.array(docs, pa.int64()), pa.array(ends - n), lists], names=["shard", "page", "place", "doc_id", "first", "ids"])

    return _pages(spark, path).mapInArrow(run, "shard int, page int, place int, doc_id long, first long, ids array<int>")


def page_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, page, page_start): ids in all pages before, from the page headers alone."""
    pages = spark.read.parquet(f"{path}/pages").select("shard", "page", F.expr("aggregate(n_tokens, 0L, (s, x) -> s + x)").alias("n"))
    inside = pages.withColumn("inside", F.sum("n").over(Window.partitionBy("shard").orderBy("page")) - F.col("n"))
    shards = pages.groupBy("shard").agg(F.sum("n").alias("total"))
    ahead = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("ahead"))  # one row a shard
    return inside.join(ahead, "shard").select("shard", "page", (F.col("ahead") + F.col("inside")).alias("page_start"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; pages decode where they are read."""
    decoded = _decoder(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, page, docs, n, ids in decoded(batches):
            raw, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(n)
            crc = [zlib.crc32(raw[i:j]) for i, j in zip((4 * (ends - n)).tolist(), (4 * ends).tolist())]
            same = [pa.array(np.full(len(docs), v, np.int32)) for v in (shard, page)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(docs, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["shard", "page", "doc_id", "first", "n_tokens", "ids_crc32"])

    sums = _pages(spark, path).mapInArrow(run, "shard int, page int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return sums.join(page_starts(spark, path), ["shard", "page"]).select("doc_id", (F.col("page_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"))
    return file_digests(spark, path)

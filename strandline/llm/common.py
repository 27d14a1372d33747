"""Helpers that the corpus operators share: tables, working folders and sorted-run iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; where none is set, a folder of this machine's in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/strandline/{name}-{uuid.uuid4().hex}"
    for made in _OWNERS[-1:]:
        made.append((None, path))
    return path


#: What the blocks of `kept_output` that run now have made, innermost last: (catalog table or None, path).
_OWNERS: list[list[tuple[str | None, str]]] = []


def kept_output(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """Write what `make` returns as a shared table and delete every working table that was made for it; and its path."""
    _OWNERS.append([])
    try:
        out, path = saved(make(), name)
    finally:
        made = _OWNERS.pop()
    for catalog, used in made:
        if catalog:
            spark.sql(f"drop table if exists {catalog}")
        if used != path:
            drop_path(spark, used)
    for outer in _OWNERS[-1:]:
        outer.append((None, path))
    return out, path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write `df` as a shared Parquet table and read it back, which cuts the lineage for lost executors; and its path.

    The shuffles of the write are no longer needed once the table is there, so Spark removes their files then.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.select("*").write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    return saved(df, name, partition_by)[0]


def bucketed(df: DataFrame, name: str, by: list[str], order: list[str], in_place: bool = False) -> tuple[DataFrame, str, str]:
    """Write `df` as a shared Parquet table in buckets of `by`, one file a bucket in order of `order`; and its name and path.

    Joins and aggregates of such tables by `by` need no shuffle, as all have as many buckets as a shuffle has
    partitions; what comes of them alone is written `in_place`, without a shuffle.
    """
    spark = df.sparkSession
    path, made, parts = work_path(spark, name), f"strandline_{uuid.uuid4().hex}", shuffle_parts(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        dealt = (df if in_place else df.repartition(parts, *by)).sortWithinPartitions(*order)
        dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, *by).sortBy(*order).saveAsTable(made)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for owned in _OWNERS[-1:]:
        owned.append((made, path))
    return spark.table(made), made, path


def drop_bucketed(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"drop table if exists {name}")
    drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a working path through Hadoop's file system interface."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def row_chunks(batches: Iterator[pa.RecordBatch], rows: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `max_bytes` of buffers, so that one chunk's arrays stay small."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * max_bytes / max(1, batch.nbytes))))
        for i in range(0, n, step):
            yield batch.slice(i, min(step, n - i))


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 65536) -> Iterator[pa.Table]:
    """Tables that hold whole groups of `key`, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])

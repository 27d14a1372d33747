"""Self-joins inside buckets without pair explosion: large buckets are dealt out as pairs of bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_parts


def dealt_buckets(entries: DataFrame, bucket: str, member: str, block_rows: int = 2048, deal: int | None = None, payload: DataFrame | None = None) -> DataFrame:
    """Entries of every bucket with two members or more, sorted by `task`, so that each task key holds all pairs of
    one bucket or of two of its blocks.

    A bucket of n rows over `block_rows` gets k = ceil(n / block_rows) blocks by a hash of `member`, and each row
    goes to its block's k meetings; every pair of rows meets at least once and no task key exceeds about twice
    `block_rows`. Adds task (long), blocks, block_a and block_b (int; the blocks that meet, equal inside one block)
    and own_block. `payload` has wide columns of each member, which join only the entries that meet others. Both joins
    sort: entries are often exploded, and Spark takes exploded rows for as small as those they come from and would send
    all of them through the driver.
    """
    sizes = entries.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    k = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    met = entries.hint("merge").join(sizes, bucket).withColumn("blocks", k).drop("n")
    met = met.withColumn("own_block", F.expr(f"cast(pmod(xxhash64({member}, 7), blocks) as int)"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("block_a", F.least("own_block", "other")).withColumn("block_b", F.greatest("own_block", "other")).drop("other")
    met = met.withColumn("task", F.xxhash64(bucket, "block_a", "block_b"))
    if payload is not None:
        met = met.hint("merge").join(payload, member)
    parts = deal or shuffle_parts(entries.sparkSession)
    return met.repartition(parts, "task").sortWithinPartitions("task")

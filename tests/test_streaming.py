"""Streams over files that come one after another, against the batch operators."""

import random

from pyspark.sql import functions as F

from strandline.operators import blocks
from strandline.streaming import live

ROWS = "run long, tr int, state int, ts timestamp"


def fed(spark, tmp_path, parts):
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def series(spark, n=60):
    pick = random.Random(3)
    rows = [(r, t, pick.randrange(3), 1_700_000_000 + 10 * t + r) for r in range(4) for t in range(n)]
    return spark.createDataFrame(rows, "run long, tr int, state int, s long").select("run", "tr", "state", F.timestamp_seconds("s").alias("ts"))


def test_blocks(spark, tmp_path):
    rows = series(spark)
    cut = [rows.where((F.col("tr") >= lo) & (F.col("tr") < lo + 20)) for lo in (0, 20, 40)]
    got = {tuple(r) for r in run(live.live_blocks(fed(spark, tmp_path, cut)), tmp_path, "closed_blocks")}
    every = blocks.state_blocks(rows).select("run", "state", "start_tr", "end_tr").collect()
    assert got == {tuple(r) for r in every if r["end_tr"] < 60} and len(got) > 100


def test_sessions(spark, tmp_path):
    at = [0, 10, 25, 100, 105, 300, 5000]
    rows = spark.createDataFrame([(1, n, 0, 1_700_000_000 + s) for n, s in enumerate(at)], "run long, tr int, state int, s long").select("run", "tr", "state", F.timestamp_seconds("s").alias("ts"))
    parts = [rows.where("tr < 3"), rows.where("tr between 3 and 5"), rows.where("tr = 6")]
    stream = fed(spark, tmp_path, parts).withColumnRenamed("run", "subject")
    got = run(live.live_sessions(stream, "30 seconds", "10 seconds"), tmp_path, "closed_sessions")
    assert sorted(r["n_events"] for r in got) == [1, 2, 3]


def test_occupancy(spark, tmp_path):
    rows = series(spark)
    parts = [rows.where("tr < 30"), rows.where("tr >= 30"), rows.where("tr = 59").withColumn("ts", F.expr("ts + interval 1 hour"))]
    got = run(live.live_occupancy(fed(spark, tmp_path, parts), "100 seconds", "20 seconds"), tmp_path, "window_counts")
    want = rows.groupBy(F.window("ts", "100 seconds").alias("window"), "run", "state").count().collect()
    assert {(r["window"]["start"], r["run"], r["state"], r["n"]) for r in got} == {(r["window"]["start"], r["run"], r["state"], r["count"]) for r in want}

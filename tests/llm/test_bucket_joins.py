"""Exploded entries meet their bucket's size and their payload by sorting, not through the driver."""

from pyspark.sql import functions as F

from strandline.llm.blocks import dealt_buckets
from strandline.llm.simhash import near_duplicates


def test_exploded_entries_are_not_broadcast(spark):
    members = spark.range(60).selectExpr("id rep", "id * 11 fp")
    entries = members.select("rep", "fp", F.explode(F.expr("array(rep % 7, 100 + rep % 4, 1000 + rep)")).alias("bucket"))
    for payload in (None, members.select("rep", F.col("fp").alias("wide"))):
        met = dealt_buckets(entries, "bucket", "rep", 5, payload=payload)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        together = {}
        for r in met.collect():
            together.setdefault(r["task"], set()).add(r["rep"])
        assert max(map(len, together.values())) <= 20
        pairs = {(a, b) for own in together.values() for a in own for b in own if a < b}
        assert pairs == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 7 == b % 7 or a % 4 == b % 4}


def test_prints_meet_their_class_by_sorting(spark):
    """Copies make the file of fingerprints small: its rows are not broadcast for that."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    found = near_duplicates(spark.createDataFrame([(i, texts[i % 2]) for i in range(40)], "doc_id long, text string"))
    assert "SortMergeJoin [fp#" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i % 2) for i in range(40)}

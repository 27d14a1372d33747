"""Dense occupancies: every run meets every state without its counts going through the driver."""

from strandline.operators import occupancy as O


def test_counts_are_not_broadcast(spark):
    states = spark.range(90).selectExpr("id % 6 run", "cast(id div 6 as int) tr", "cast(id * 7 % 5 % 3 as int) state")
    got = O.fractional_occupancy(states, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = {(r, s): 0 for r in range(6) for s in range(4)}
    for i in range(90):
        want[i % 6, i * 7 % 5 % 3] += 1
    assert {(r["run"], r["state"]): (r["n"], r["n_trs"], r["fo"]) for r in got.collect()} == {k: (n, 15, n / 15) for k, n in want.items()}

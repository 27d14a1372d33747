"""Steps whose tasks must not grow with the input: parts by the number of rows, draws that are not rows."""

import numpy as np

from strandline.operators import nulls as N
from strandline.operators import ridge
from strandline.sources import working


def test_area_parts_follow_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(s), bool(y)) for g, s, y in zip(rng.integers(0, 2, 300), rng.integers(0, 40, 300), rng.random(300) < 0.4)]
    frame = spark.createDataFrame(rows, "g int, s double, y boolean")
    asked = []
    monkeypatch.setattr(ridge, "parts_of", lambda spark, n: asked.append(n) or working.parts_of(spark, n))
    monkeypatch.setattr(working, "TASK_ROWS", 20)
    got = {r["g"]: r["auc"] for r in ridge.ranked_areas(frame, "s", "y", ["g"]).collect()}
    assert asked == [300] and working.parts_of(spark, 300) == 15
    for g in (0, 1):
        own = [(s, y) for k, s, y in rows if k == g]
        wins = [(a > b) + (a == b) / 2 for a, p in own if p for b, q in own if not q]
        assert abs(got[g] - np.mean(wins)) < 1e-12


def test_return_draws_are_not_rows(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(N, "written", lambda df, name: taken.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    visits = spark.range(60).selectExpr("cast(id % 3 as int) state", "id % 5 run", "id visit", "cast(id * 7 % 4 as int) a", "cast(id * 5 % 4 as int) b")
    N.excess_returns(visits, 20, 3)
    assert taken and not any("Generate explode" in p or "Window" in p for p in taken)

"""Each source's words in every tenth of training against the integral of its schedule."""

import random
from collections import Counter

import pytest

from strandline.llm import mixing

SCHEDULES = [(3.0, 3.0), (1.0, 4.0), (2.0, 2.0), (4.0, 1.0), (0.0, 2.0)]


def dealt(w0, w1, t):
    """The share of a linear schedule's integral that lies before t."""
    return (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)


@pytest.mark.parametrize("share", [0.7, 1.5])
def test_tenths(spark, share):
    pick = random.Random(4)
    rows = [(len(SCHEDULES) * i + s, "w " * pick.randrange(5, 30), f"s{s}") for s in range(len(SCHEDULES)) for i in range(150 + 150 * s)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix(df, share=share, schedule=lambda i: SCHEDULES[i]).cache()
    plan = {r["source"]: r for r in made.select("source", "source_size", "target").distinct().collect()}
    ratios = [r["target"] / r["source_size"] for r in plan.values()]
    assert any(0 < x < 0.95 for x in ratios) and (share < 1 or any(1.05 < x < 1.95 for x in ratios))
    words = Counter()
    for r in mixing.curriculum(made).select("source", "size", "position").collect():
        assert 0 <= r["position"] <= 1
        words[r["source"], min(9, int(10 * r["position"]))] += r["size"]
    for source, r in plan.items():
        w = SCHEDULES[int(source[1:])]
        for tenth in range(10):
            want = r["target"] * (dealt(*w, (tenth + 1) / 10) - dealt(*w, tenth / 10))
            assert abs(words[source, tenth] - want) <= 61, (source, tenth, words[source, tenth], want)
    first = {r["doc_id"]: r["position"] for r in made.where("copies > 0").select("doc_id", "position").collect()}
    order = {}
    for r in mixing.curriculum(made).collect():
        order.setdefault(r["doc_id"], []).append((r["copy"], r["position"]))
    assert all(sorted(o)[0][1] == first[d] and [p for _, p in sorted(o)] == sorted(p for _, p in o) for d, o in order.items())


def test_repeated_rows(spark):
    """Rows that repeat, some of them with other columns of their own: every source comes within half its longest document."""
    rows = [(1, "a b c d", "s0", n) for n in range(10)] + [(2, "e f g", "s0", 0)] * 5 + [(10 + i, "w " * (i % 7), f"s{i % 3}", i) for i in range(60)] + [(3, None, None, 0)] * 4
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, source string, mark int")
    for share in (0.3, 0.9, 1.5):
        got = mixing.mix(df, share=share).collect()
        assert Counter((r["doc_id"], r["mark"]) for r in got) == Counter((d, m) for d, _, _, m in rows * 3)
        taken, target = Counter(), {}
        for r in got:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert r["taken"] <= 2 * r["size"]
        assert all(abs(taken[s] - target[s]) <= 3 for s in target), (share, taken, target)

"""Two sets of fits and four states in a row, held against enumeration."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from strandline.operators import compare, nulls

WORSE = {"near": "lower", "far": "higher"}


def fitted(n, k, seed, gap=0.0):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=n) + gap * (np.arange(n) < k)
    return [(i, j, float(-abs(at[i] - at[j])), float(abs(at[i] - at[j]))) for i, j in itertools.combinations(range(n), 2)]


def statistic(rows, chosen):
    inside = [(i in chosen) == (j in chosen) for i, j, _, _ in rows]
    med = lambda c, w: np.median([r[c] for r, s in zip(rows, inside) if s == w])
    return med(2, True) - med(2, False), med(3, False) - med(3, True)


@pytest.mark.parametrize("n,k,gap", [(7, 3, 0.0), (8, 4, 4.0), (3, 1, 0.0)])
def test_splits_by_enumeration(spark, n, k, gap):
    rows = fitted(n, k, n, gap)
    pairs = spark.createDataFrame(rows, "i int, j int, near double, far double")
    fits = spark.createDataFrame([(i, i < k) for i in range(n)], "fit int, a boolean")
    got = {r["metric"]: r for r in compare.split_test(pairs, fits, WORSE).collect()}
    seen = statistic(rows, set(range(k)))
    drawn = [statistic(rows, set(c)) for c in itertools.combinations(range(n), k)]
    for m, at in (("near", 0), ("far", 1)):
        assert got[m]["statistic"] == pytest.approx(seen[at]) and got[m]["n_splits"] == math.comb(n, k) and got[m]["exact"]
        assert got[m]["p"] == pytest.approx(np.mean([x[at] >= seen[at] - 1e-12 for x in drawn]))
    drawn = {r["metric"]: r for r in compare.split_test(pairs, fits, WORSE, max_exact=1, n_random=400, seed=3).collect()}
    assert all(drawn[m]["n_splits"] == 401 and not drawn[m]["exact"] and abs(drawn[m]["p"] - got[m]["p"]) < 0.12 for m in WORSE)


def test_split_edges(spark):
    rows = fitted(4, 2, 1)
    make = lambda r: spark.createDataFrame(r, "i int, j int, near double, far double")
    fits = spark.createDataFrame([(i, i < 2) for i in range(4)], "fit int, a boolean")
    with pytest.raises(ValueError):
        compare.split_test(make(rows[1:]), fits, WORSE)
    with pytest.raises(Exception, match="no finite value"):
        compare.split_test(make([(0, 1, None, 1.0), *rows[1:]]), fits, WORSE)
    assert not compare.split_test(make(rows), fits.withColumn("a", fits.a.isNotNull()), WORSE).collect()
    assert not compare.split_test(make(rows), fits.limit(0), WORSE).collect()


def test_moved(spark):
    make = lambda r: spark.createDataFrame(r, "near double, far double")
    within = make([(0.9, 1.0), (0.7, 3.0), (0.8, 2.0)])
    rule = lambda a, b: {r["metric"]: (r["outside"], r["moved"]) for r in compare.moved(make([(a, b)]), within, WORSE).collect()}
    assert rule(0.7, 3.0) == {"near": (False, False), "far": (False, False)}
    assert rule(0.69, 0.0) == {"near": (True, True), "far": (False, True)}
    assert rule(2.0, 3.01) == {"near": (False, True), "far": (True, True)}
    with pytest.raises(Exception, match="no finite value"):
        rule(float("nan"), 1.0)
    assert not compare.moved(make([(0.5, 1.0)]), within.limit(0), WORSE).collect()


def test_fourgrams_by_counting(spark):
    rng = np.random.default_rng(5)
    runs = {}
    for r in range(30):
        s = [0]
        while len(s) < 40:
            s.append(int(rng.choice([x for x in range(4) if x != s[-1]], p=[0.6, 0.25, 0.15] if len(s) > 2 and s[-2] == 1 else [0.2, 0.3, 0.5])))
        runs[r] = s
    rows = [(r, i, x) for r, s in runs.items() for i, x in enumerate(s)] + [(99, 0, 1)]
    changes = spark.createDataFrame(rows, "run int, pos int, state int")
    got = {r["gram"]: r for r in nulls.fourgram_test(changes).collect()}
    grams = lambda n: Counter(tuple(s[i : i + n]) for s in runs.values() for i in range(len(s) - n + 1))
    four, three = grams(4), grams(3)
    want = {}
    for g, n in four.items():
        context = sum(v for k, v in four.items() if k[:3] == g[:3])
        other = sum(v for k, v in three.items() if k[:2] == g[1:3]) - context
        if n >= 3 and other >= 5 and three[g[1:]] - n > 0:
            e = context * (three[g[1:]] - n) / other
            want[">".join(map(str, g))] = (n, context, other, e, (n - e) / math.sqrt(e) if e >= 5 else None)
    assert set(got) == set(want) and len(want) > 30
    tested = []
    for g, (n, context, other, e, z) in want.items():
        r = got[g]
        assert (r["n"], r["n_context"], r["n_other"]) == (n, context, other) and r["expected"] == pytest.approx(e) and r["excess"] == pytest.approx((n - e) / e)
        assert (r["z"] is None and r["p"] is None) if z is None else (r["z"] == pytest.approx(z) and r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2))))
        assert r["survives"] == (r["q"] < 0.05 and r["excess"] > 0)
        tested += [] if z is None else [(r["p"], r["q"])]
    low = 1.0
    for k, (p, q) in sorted(enumerate(sorted(tested), 1), reverse=True):
        low = min(low, p * len(tested) / k)
        assert q == pytest.approx(low)
    assert not nulls.fourgram_test(changes.limit(0)).collect()

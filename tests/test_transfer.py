"""Classifiers carried from one table to another, held against one plain fit a label vector."""

import numpy as np
import pytest

from strandline.operators import ridge


def made(seed, n, k, d, runs):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    x = rng.normal(size=(n, d)) + 5 + y[:, None] * np.linspace(0, 0.8, d)
    return [(int(i % runs), int(i // runs), [float(v) for v in x[i]], int(y[i]), ["u", "v", None][i % 3]) for i in range(n)]


SCHEMA = "run long, tr int, features array<double>, label int, subset string"


def plain(x, y, classes, alpha):
    """(coef, offset) of a weighted ridge on +1 and -1 targets by the full normal equations with an unpenalised intercept."""
    w = np.array([len(y) / (len(classes) * (y == y[i]).sum()) for i in range(len(y))])
    z = np.column_stack([np.ones(len(x)), x])
    t = np.stack([np.where(y == c, 1.0, -1.0) for c in classes], axis=1)
    pen = alpha * np.eye(z.shape[1])
    pen[0, 0] = 0
    return np.linalg.solve((z * w[:, None]).T @ z + pen, (z * w[:, None]).T @ t)


@pytest.mark.parametrize("k", [2, 4])
def test_transfer_against_plain_fits(spark, k):
    train, test = made(1, 240, k, 3, 6), made(2, 150, k, 3, 5)
    a, b = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA)
    a = ridge.shifted_labels(a, 3, 11)
    held = a.orderBy("run", "tr").toPandas()
    got = {(r["target"], r["subset"], r["label"], r["predicted"]): r["n"] for r in ridge.transfer(a, b, ["label", "null_1", "null_2", "null_3"], "subset").collect()}
    want = {}
    x = np.array(held["features"].tolist())
    for t, name in enumerate(["label", "null_1", "null_2", "null_3"]):
        beta = plain(x, held[name].to_numpy(), np.arange(k), 1.0)
        for _, _, f, y, s in test:
            key = (t, s, y, int((np.array([1.0, *f]) @ beta).argmax()))
            want[key] = want.get(key, 0) + 1
    assert got == want
    found = {r["subset"]: r for r in ridge.transfer_test(ridge.transfer(a, b, ["label", "null_1", "null_2", "null_3"], "subset"), k).collect()}
    assert set(found) == {"u", "v", None, "all"}
    acc = [np.mean([sum(n for (t, _, y, p), n in want.items() if t == at and y == p == c) / sum(n for (t, _, y, _), n in want.items() if t == at and y == c) for c in range(k)]) for at in range(4)]
    assert found["all"]["balanced_accuracy"] == pytest.approx(acc[0]) and found["all"]["null_mean"] == pytest.approx(np.mean(acc[1:]))
    assert found["all"]["p"] == pytest.approx((1 + sum(v >= acc[0] - 1e-12 for v in acc[1:])) / 4) and found["all"]["n"] == 150
    assert found["all"]["effect"] == pytest.approx((acc[0] - 1 / k) / (1 - 1 / k))


def test_odd_rows(spark):
    train = made(3, 60, 3, 2, 3) + [(9, 0, None, 1, "u"), (9, 1, [1.0, float("nan")], 1, "u"), (9, 2, [1.0, None], 0, "u"), (9, 3, [1.0, 1.0], None, "u")]
    test = made(4, 40, 3, 2, 3) + [(9, 0, [1.0, float("inf")], 1, "u"), (9, 1, [0.0, 0.0], 7, "u"), (9, 2, [0.0, 0.0], None, "u")]
    a, b = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA)
    assert sum(r["n"] for r in ridge.transfer(a, b, ["label"], "subset").collect()) == 40
    lacking = a.selectExpr("*", "case when label = 2 then 1 else label end as other")  # this vector never has the class 2
    assert {r["target"] for r in ridge.transfer(lacking, b, ["label", "other"], "subset").collect()} == {0}
    assert not ridge.transfer(a.where("label = 1"), b, ["label"], "subset").collect()
    assert not ridge.transfer(a.limit(0), b, ["label"], "subset").collect()
    assert not ridge.transfer(a, b.limit(0), ["label"], "subset").collect()
    first, second = ridge.in_both(a, b.where("label <> 0"))
    assert {r[0] for r in first.select("label").distinct().collect()} == {1, 2} == {r[0] for r in second.select("label").distinct().where("label < 5").collect()}

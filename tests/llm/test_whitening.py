"""Whitening against a dense eigendecomposition of the exact covariance."""

import numpy as np
import pytest

from strandline.llm import whitening
from strandline.llm.registry import QUERIES
from strandline.llm.topk import quantised

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, k=4, scale=256):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, vector) rows."""
    kept = [(v, [int(np.floor(scale * float(c))) for c in x]) for v, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.float64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for v, x in kept:
        for j in range(min(k, len(e))):
            w = abs((np.array(x) - fit.mean(axis=0)) @ u[:, j] / np.sqrt(e[j])) if e[j] > 1e-9 * max(e.sum(), 1e-300) else 0.0
            out.append((v, j + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), w, e[j] / e.sum() if e.sum() > 0 else 0.0))
    return out


def compare(got, want, tolerance=1e-6):
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: (r["vec_id"], r["component"])), sorted(want)):
        assert (r["vec_id"], r["component"], r["n"], r["deviation"]) == w[:4]
        assert abs(abs(r["whitened"]) - w[4]) <= tolerance * (1 + w[4]) and abs(r["explained"] - w[5]) <= 1e-9 + 1e-4 * w[5]
        assert r["identity_error"] <= 1e-4


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert got.columns == COLUMNS
    compare(got.collect(), plain(rows))


def vectors(spark, rows):
    return quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, q int, label int"), 256.0)


def test_range_finder_settles_before_the_full_dimension(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 40)) * np.r_[8.0, 5.0, 3.0, 2.0, np.full(36, 0.02)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = vectors(spark, [(i, v, 1, 2, 3) for i, v in rows])
    model = whitening.fit_whitening(df.select("q").distinct())
    assert not model.full and model.passes <= 6
    compare(whitening.whiten(df).collect(), plain(rows), 1e-8)


def test_flat_spectrum_expands(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, 24)))]
    df = vectors(spark, [(i, v, 1, 2, 3) for i, v in rows])
    assert whitening.fit_whitening(df.select("q").distinct()).full
    compare(whitening.whiten(df).collect(), plain(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    """Copies weigh once; null, empty and non-finite vectors are left out; null ids stay; every row of a repeated id is returned."""
    rng = np.random.default_rng(seed)
    base = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(30, 6)))]
    rows = base + [(100 + i, base[0][1]) for i in range(60)] + [(3, base[4][1])]
    odd = [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, [(i, v, 1, 2, 3) for i, v in rows + odd])).collect()
    want = plain(rows)
    key = lambda r: (r[0], r[1], r[3])
    assert sorted(map(key, got)) == sorted(map(key, want)) and {r["n"] for r in got} == {30}
    assert whitening.whiten(vectors(spark, [(None, v, 1, 2, 3) for _, v in base])).where("vec_id is null").count() == 120


def test_few_dimensions_and_rows(spark):
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 1, 2, 3)])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    line = whitening.whiten(vectors(spark, [(i, [i / 4, i / 2, 0.0], 1, 2, 3) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1, 2, 3} and all(r["whitened"] == 0 for r in line if r["component"] > 1)
    assert abs(sum(r["whitened"] ** 2 for r in line) / 5 - 1) < 1e-9
    assert whitening.whiten(vectors(spark, [(1, None, 1, 2, 3)])).count() == 0


def test_deviation_beyond_64_bits_is_an_error(spark):
    model = whitening.Whitening(10**9, np.array([0]), np.eye(1), np.ones(1), 1.0, 1, True)
    assert model.deviations(np.array([[3]])).tolist() == [9 * 10**18]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[4]]))

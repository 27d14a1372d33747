"""Rotations by what they keep, and planted matches between participants."""

import numpy as np

from strandline.operators import surrogates as Q


def test_rotations_keep_what_they_should():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(12, 30)) + 3
    q = Q.random_rotation(6, rng)
    assert np.allclose(q @ q.T, np.eye(6))
    mixed = Q.mixed_states(m, rng)
    c, d = m - m.mean(axis=0), mixed - mixed.mean(axis=0)
    assert np.allclose(mixed.mean(axis=0), m.mean(axis=0)) and np.allclose(c.T @ c, d.T @ d) and not np.allclose(mixed, m)
    turned = Q.rotated_configuration(m, rng)
    d = turned - turned.mean(axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2][:11]
    assert np.allclose(c @ c.T, d @ d.T) and np.allclose(d @ v.T @ v, d) and not np.allclose(c, d)
    z = rng.normal(size=(4, 13))
    blocks = Q.rotated_blocks(z, rng, 5)
    assert all(np.allclose(np.linalg.norm(z[:, a : a + 5], axis=1), np.linalg.norm(blocks[:, a : a + 5], axis=1)) for a in (0, 5, 10)) and not np.allclose(z, blocks)
    assert np.allclose(Q.mixed_states(m[:1], rng), m[:1]) and np.allclose(Q.rotated_configuration(m[:1], rng), m[:1])
    assert np.allclose(Q.correlations(m, m), np.corrcoef(m)) and (Q.correlations(np.ones((2, 4)), m[:, :4]) == 0).all()


def test_planted_matches(spark):
    rng = np.random.default_rng(2)
    shared = rng.normal(size=(8, 40))
    maps = [(0, s, (shared[s] + 0.5 * rng.normal(size=40)).tolist()) for s in range(8)] + [(1, s, (shared[7 - s] + 0.5 * rng.normal(size=40)).tolist()) for s in range(8)]
    maps += [(2, s, rng.normal(size=40).tolist()) for s in range(6)]
    frame = spark.createDataFrame(maps, "subject int, state int, map array<double>")
    pairs = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 0, 9)], "pair long, a int, b int")
    for kind in Q.KINDS:
        got = {r["pair"]: r for r in Q.matching_test(frame, pairs, 39, 5, kind).collect()}
        assert set(got) == {1, 2} and got[1]["p"] == got[1]["p_family"] == 1 / 40 and got[1]["n_matched"] == 8 and got[1]["median_r"] > 0.6
        assert got[2]["n_matched"] == 6 and got[2]["p"] > 0.05 and got[2]["p_family"] >= got[2]["p"]

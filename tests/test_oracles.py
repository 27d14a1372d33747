"""Every registered state-sequence query against its SQL in DuckDB, on the same tables."""

import math
import os

import duckdb
import pytest

from strandline.plans.graphs import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = [[r[i] for i in order] for r in rows]
    return sorted(plain, key=lambda r: [(x is not None, round(x, 6) if isinstance(x, float) else x) for x in r])


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    got, want = canonical([tuple(r) for r in df.collect()], df.columns), canonical(want.fetchall(), cols)
    assert len(got) == len(want)
    # chains in five runs, training episodes beside test and validation and four-grams seen three times with five other
    # successors are not there in the smallest table (on sf0.01 178 such four-grams agree)
    assert want or name in ("st21_chain_preservation", "sp6_training_runs", "st20_fourgram_null")
    wrong = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not wrong, wrong[:3]


def test_every_query_runs(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, sf_dir).count() > 0, name

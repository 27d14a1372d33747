"""Each registered corpus query against its plain version on the small tables."""

import hashlib
import os
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from strandline.llm.licenses import TEMPLATES  # noqa: E402
from strandline.llm.registry import ORACLE_SQL, QUERIES  # noqa: E402
from strandline.llm.tokens import vocabulary_path  # noqa: E402


def run(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def rows_of(spark, sf_dir, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols).collect()]


def test_license_scan(spark, sf_dir):
    texts = dict(rows_of(spark, sf_dir, "documents", "doc_id", "text"))
    got = run(spark, sf_dir, "op1_license_scan")
    assert len(got) == len(texts)
    every = dict(zip(texts, brute.license_scan(list(texts.values()), TEMPLATES)))
    for r in got:
        assert r["labels"] == every[r["doc_id"]][0] and abs(r["score"] - every[r["doc_id"]][1]) < 1e-9
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.base_license(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
    assert any(r["n_base"] for r in got)


def test_chat_formatting(spark, sf_dir):
    by = defaultdict(list)
    for conv, turn, role, text in rows_of(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"):
        by[conv].append((turn, role, text))
    by[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in run(spark, sf_dir, "op2_chat_formatting")}
    assert set(got) == set(by)
    for conv, turns in by.items():
        want = brute.talk([(role, text) for _, role, text in sorted(turns)])
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def test_packing(spark, sf_dir):
    tokenizer = brute.library(vocabulary_path("byte_bpe_50k.json"))
    got = run(spark, sf_dir, "op3_best_fit_packing")
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    total = 0
    for doc, text in rows_of(spark, sf_dir, "documents", "doc_id", "text"):
        ids = brute.token_ids(tokenizer, text)
        pieces = sorted(by.pop(doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 1024)
        at = 0
        for n, r in enumerate(pieces):
            assert r["start"] == at and (r["length"] == 1024 or n == 0)
            assert r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
        total += at
    assert not by
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    large = sum(r["length"] > 512 for r in got)
    assert len(bins) <= 1.03 * max(-(-total // 1024), large) + 1


def test_topk(spark, sf_dir):
    want = brute.top_scores(rows_of(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in run(spark, sf_dir, "op4_exact_topk"))
    assert got == sorted(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf_dir).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_mixing(spark, sf_dir):
    rows = {d: (brute.word_size(t), s) for d, t, s in rows_of(spark, sf_dir, "documents", "doc_id", "text", "source")}
    sizes = Counter()
    for n, s in rows.values():
        sizes[s] += n
    want = brute.targets(sizes)
    got = run(spark, sf_dir, "op5_curriculum_mixing")
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        n, s = rows[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    most = Counter()
    for n, s in rows.values():
        most[s] = max(most[s], n)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    again = run(spark, sf_dir, "op5_curriculum_mixing")
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}


def test_simhash(spark, sf_dir):
    want = brute.simhash_components(rows_of(spark, sf_dir, "documents", "doc_id", "text"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, sf_dir, "op6_simhash_near_dedup")}
    assert got == want


def test_toxicity_held_out(spark):
    """Labels carry noise (about a tenth of the toxic ones mark texts without any insult), so no score reaches 1."""
    sf = "/root/testdata/sf0.1"
    toxic = {d: t for d, t in rows_of(spark, sf, "labels", "doc_id", "toxic") if t is not None}
    got = {r["doc_id"]: r for r in run(spark, sf, "op7_string_kernel_toxicity")}
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[d]["score"], t, got[d]["predicted"]) for d, t in toxic.items() if d in got and got[d]["held_out"]]
    pos, neg = np.array([s for s, t, _ in held if t]), np.array([s for s, t, _ in held if not t])
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] >= neg).mean()) / 2
    accuracy = np.mean([t == p for _, t, p in held])
    assert auc >= 0.94 and accuracy >= 0.94, (auc, accuracy)


def test_token_files(spark, sf_dir):
    tokenizer = brute.library(vocabulary_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op8_token_files")}
    at = 0
    for doc, text in sorted(rows_of(spark, sf_dir, "documents", "doc_id", "text")):
        ids = brute.token_ids(tokenizer, text)
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), brute.crc(ids))
        at += len(ids)


def planted_vectors(spark, path):
    """Groups around common centres at angles on both sides of the bound, exact copies, and rows that take no part."""
    rng = np.random.default_rng(3)
    rows = []
    for group in range(60):
        centre = rng.normal(size=64)
        for spread in rng.uniform(0.0, 0.5, 12):
            v = centre / np.linalg.norm(centre) + spread * rng.normal(size=64) / 8
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(group % 3)))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(50)]
    rows += [(len(rows), None, 1), (len(rows) + 1, [0.0] * 64, 1), (len(rows) + 2, [float("nan")] * 64, 1), (len(rows) + 3, rows[0][1], None), (len(rows) + 4, [None] * 64, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return rows


def test_lattice_near_dedup(spark, tmp_path):
    want = brute.vector_links(planted_vectors(spark, tmp_path))
    got = {r["vec_id"]: r for r in run(spark, str(tmp_path), "op9_lattice_near_dedup")}
    assert set(got) == set(want)
    assert all(got[v]["n_links"] <= n for v, (n, _) in want.items())
    found, there = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.9 * there > 1000, (found, there)
    assert all(r["kept"] == (v == r["component_id"]) for v, r in got.items())


def test_suffix_array_dedup(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "documents", "doc_id", "text")
    want = {d: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (d, _), w in zip(rows, brute.repeats([t for _, t in rows]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, sf_dir, "op10_suffix_array_dedup")}
    assert got == want

"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from strandline.llm.jaccard import jaccard_links  # noqa: E402


def shingles(text):
    words = brute.WORD.findall((text or "").translate(brute.LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_pairs(sets, least=0.8):
    """Index pairs of equal or near sets, found through their shared shingles."""
    by = {}
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(i)
    pairs = {(a, b) for held in by.values() for b in held for a in held if a < b}
    return [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]


def planted():
    """Originals, each with copies from which some words are changed, on both sides of the bound."""
    pick = random.Random(9)
    word = lambda: "w%d" % pick.randrange(5000)
    texts = []
    for _ in range(60):
        base = [word() for _ in range(pick.randrange(60, 300))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(word() if pick.random() < share else w for w in base))
    return texts + ["", " \n", None, "one two", "One  two"]


@pytest.mark.parametrize("block_rows", [512, 2])
def test_recall(spark, block_rows):
    texts = planted()
    sets = [shingles(t) for t in texts]
    pairs = near_pairs(sets)
    assert len(pairs) > 150
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    links = [tuple(r) for r in jaccard_links(df, block_rows=block_rows).collect()]
    assert brute.components(len(texts), links) == brute.components(len(texts), pairs)


def test_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    place = {d: i for i, (d, _) in enumerate(rows)}
    bits = [(place[c], place[d]) for d, (_, c) in brute.simhash_components(rows).items()]
    low = brute.components(len(rows), bits + near_pairs([shingles(t) for _, t in rows]))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r[0] for r in kept.select("doc_id").collect()} == {rows[i][0] for i, c in enumerate(low) if i == c}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0

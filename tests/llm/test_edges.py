"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every corpus operator."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from test_near_stage import near_pairs, shingles  # noqa: E402

import corpus_pipeline  # noqa: E402
from strandline.llm import chat, codec, components, lattice, licenses, mixing, packing, simhash, suffixes, topk, toxicity  # noqa: E402
from strandline.llm.common import work_path  # noqa: E402
from strandline.llm.tokens import vocabulary_path  # noqa: E402

LONG = "alpha beta gamma delta under the MIT License. " * 3000
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, LONG), (6, LONG), (6, LONG), (None, "one two three four five"), (8, "Ünder ퟿ under the mit license \x00 end"), (9, "x" * 5000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, size string, h long, word string, rank0 int, part int, component string, score double, _s string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), 1, "big", 7, "w", 1, 1, "c", 0.5, "q") for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0), (5, 1), (8, None)], "doc_id long, toxic int")


def test_licenses(spark, odd):
    got = licenses.scan_licenses(odd).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in got))) == sorted(map(str, ((d, *brute.base_license(t)[:4]) for d, t in TEXTS)))
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_license_notices(spark):
    """Whole notices, notices with words lost or between, notices in pieces and words without their phrase."""
    notices = [t for _, t, _ in licenses.TEMPLATES]
    texts = [f"Intro words {n}; {t.upper()} and more." for n, t in enumerate(notices)]
    texts += [" ".join(w for i, w in enumerate(t.split()) if i % 17 != 16) for t in notices] + [" ".join(t.split()[::-1]) for t in notices]
    texts += [f"{a} -- {b}" for a, b in zip(notices, notices[1:])] + [t[: len(t) // 2] for t in notices] + [None, "", "the the the", *["gnu general public license version 3"] * 3]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: (labels, round(score, 9)) for i, (labels, score) in enumerate(brute.license_scan(texts, licenses.TEMPLATES))}
    assert got == want
    assert all(label in want[i][0].split(",") for i, (label, _, _) in enumerate(licenses.TEMPLATES))


def test_packing(spark, odd):
    got = packing.pack_documents(odd).collect()
    tokenizer = brute.library(vocabulary_path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in got) == sum(len(brute.token_ids(tokenizer, t)) for _, t in TEXTS)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack_documents(odd.limit(0)).count() == 0
    made = packing.sequences(packing.pack_documents(odd.where("doc_id <> 6")), odd.where("doc_id <> 6")).collect()
    assert all(len(r["ids"]) <= 1024 for r in made)


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0
    taken = mixing.curriculum(mixing.mix(odd, schedule=lambda i: (3.0, 1.0) if i % 2 else (1.0, 2.0)))
    at = [r["position"] for r in taken.collect()]
    assert at == sorted(at)


def test_simhash(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS)
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_toxicity(spark, odd, labels):
    model = toxicity.train(odd, labels)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    empty = toxicity.train(odd.limit(0), labels.limit(0))
    assert toxicity.score_toxicity(odd.limit(0), empty).count() == 0


def test_string_kernel():
    """Kernel values against a count of all gapped subsequences, and scores of whole texts against single sentences."""
    import math
    from collections import Counter

    import numpy as np

    def features(line):
        out, total = Counter(), 0.0
        for i in range(len(line)):
            for a in (1, 2, 3):
                for b in (1, 2, 3):
                    if i + a + b < len(line):
                        w = 0.6 ** (a + b - 2)
                        out[line[i], line[i + a], line[i + a + b]] += w
                        total += w * w
        return {k: x / math.sqrt(total or 1.0) for k, x in out.items()}

    lines = [" you idiot ", " you i*d*i*o*t ", " an idiom of ours ", " ab ", " ", "", " ünïçödé words here ", "x" * 400]
    got = toxicity.kernel(lines, lines, block=3)
    for i, s in enumerate(lines):
        for j, t in enumerate(lines):
            a, b = features(s), features(t)
            want = sum(x * b.get(k, 0.0) for k, x in a.items())
            assert abs(got[i, j] - want) < 2e-3 * max(1.0, want), (s, t)
    assert got[0, 1] > 2 * got[3, 1]
    text = "One sentence here. Another, with a comma;\nnew line: e.g. 3.14 stays! " + "long " * 90 + "\n \n end"
    own, of = toxicity.sentences(["", text, " \t\n", "two. words"])
    assert own[:4] == [" one sentence here ", " another ", " with a comma ", " new line "] and " e.g " in own and " 3.14 stays " in own and own[-2:] == [" two ", " words "]
    assert set(of.tolist()) == {1, 3} and max(map(len, own)) <= 160 and [x.strip() for x in own].count("end") == 1
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32), 0.25, 1.0, 0.0)
    s, b, x = toxicity.features(own)
    each = np.bincount(s, model.weights[b] * x, len(own)) + 0.25
    assert np.allclose(model.of_texts(["", text, " \t\n", "two. words"]), [np.nan, each[of == 1].max(), np.nan, each[of == 3].max()], atol=1e-4, equal_nan=True)


def test_toxicity_learns_from_its_rows_only(spark):
    """Insults learnt from clear rows are found gapped and broken; labels of held-out rows change nothing."""
    import random
    import zlib

    pick = random.Random(6)
    word = lambda: "".join(pick.choice("aeioulnrst") for _ in range(pick.randrange(2, 9)))
    rows, marks = [], []
    for d in range(600):
        words = [word() for _ in range(60)]
        toxic = d % 4 == 0
        if toxic:
            words[pick.randrange(60)] = pick.choice(["blurgh", "zwackik"])
        rows.append((d, " ".join(w + ("." if n % 9 == 8 else "") for n, w in enumerate(words))))
        marks.append((d, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    other = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in marks], "doc_id long, toxic int")
    small = dict(sentence_rows=400, n_landmarks=120, rounds=2)
    model, same = toxicity.train(docs, labels, **small), toxicity.train(docs, other, **small)
    assert (model.weights == same.weights).all() and (model.slope, model.shift) == (same.slope, same.shift)
    held = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    toxic, clean = [x for d, x in held.items() if d % 4 == 0], [x for d, x in held.items() if d % 4]
    assert sum(a > b for a in toxic for b in clean) >= 0.97 * len(toxic) * len(clean)
    asked = spark.createDataFrame([(0, "solo una ble.urgh rete zwack*ik tono"), (1, "solo una rete tono"), (2, "solo z.w.a.c.k.i.k rete")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(asked, model).collect()}
    assert score[0] > 0.3 > score[1] and score[2] > score[1]


def test_suffixes(spark, odd):
    got = suffixes.remove_repeats(odd).collect()
    want = brute.repeats([t for _, t in TEXTS])
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(want)
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


def test_suffixes_shared_passage(spark):
    """One passage in different surroundings and at every alignment, beside a passage a byte too short."""
    import random

    pick = random.Random(5)
    noise = lambda n: "".join(pick.choice("abcdefghij ") for _ in range(n))
    passage, short = noise(260), noise(199)
    texts = [noise(37 * i) + passage + noise(300) + short + noise(13 * i) for i in range(12)] + [passage[30:] + noise(90), short]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))


def test_suffix_family(spark):
    """Ten batches one by one: levels of 8 and 2, arrays in byte order within a bucket, and every repeated head found when it comes."""
    import random
    from collections import Counter

    pick = random.Random(8)
    blocks = ["".join(pick.choice("abcdefgh ") for _ in range(400)) for _ in range(30)]
    texts = [(i, "".join(pick.sample(blocks, 2)) + f" {pick.random()} " * 20) for i in range(60)]
    df = spark.createDataFrame([(i, i, t) for i, t in texts], "k long, h long, text string")
    rows = suffixes.anchored_suffixes(df, 10, 200).cache()
    family, seen = suffixes.IndexFamily(), Counter()
    for n in range(10):
        own = Counter(r["head"] for r in rows.where(F.col("batch") == n).collect())
        got = {r["head"] for r in family.add(rows.where(F.col("batch") == n)).collect()}
        assert got == {x for x, k in own.items() if k > 1 or x in seen}
        seen += own
    assert [size for size, *_ in family.levels] == [8, 2]
    level = family.levels[0][1].withColumn("file", F.input_file_name()).collect()
    for name in {r["file"] for r in level}:
        keys = [(r["lead"], r["head"], r["cover"]) for r in level if r["file"] == name]
        assert keys == sorted(keys)
    matches = family.long_matches().collect()
    assert {r["head"] for r in matches} == {x for x, k in seen.items() if k > 1}
    assert sum(r["n"] for r in matches) == sum(k for k in seen.values() if k > 1)
    family.drop()


def test_token_files(spark, odd):
    path = work_path(spark, "odd-files")
    codec.write_token_files(odd, path, vocabulary_path("word_bpe_49k.json"))
    got = codec.file_digests(spark, path).collect()
    tokenizer = brute.library(vocabulary_path("word_bpe_49k.json"))
    assert sorted(r["ids_crc32"] for r in got) == sorted(brute.crc(brute.token_ids(tokenizer, t)) for _, t in TEXTS)
    path = work_path(spark, "no-files")
    codec.write_token_files(odd.limit(0), path, vocabulary_path("word_bpe_49k.json"))
    assert codec.file_digests(spark, path).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (40, None, 1), (3, [None, 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [0.0, 0.0], 1), (6, [0.5, 0.5], None)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, label int, keys string, n int")
    got = lattice.near_vectors(df).collect()
    assert len(got) == len(rows) and {r["n_links"] for r in got if r["vec_id"] in (0, 20)} == {2}
    assert all(r["n_links"] == 0 for r in got if r["vec_id"] in (40, 3, 4, 5, 6))
    assert lattice.near_vectors(df.limit(0)).count() == 0
    named = lattice.near_vectors(df.withColumn("label", F.concat(F.lit("kind "), F.col("label").cast("string")))).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in named) == sorted((r["vec_id"], r["n_links"]) for r in got)
    q = topk.quantised(df)
    best = topk.exact_topk(q, q.where("vec_id % 20 = 0"), k=3)
    assert {r["query_id"] for r in best.collect()} == {0, 20}
    assert topk.exact_topk(q.limit(0), q.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, 0, "message", "user", "a\\<s>[b"), (1, 1, 0, "message", "assistant", "x"), (1, 1, 1, "delta", None, "</s>y"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "fin"),
        (1, 2, 0, "message", None, None), (1, 3, 0, "message", "tool]", "t"), (1, 4, 0, "message", "user", "gone"), (1, 4, 1, "delete", None, None), (None, 0, 0, "message", "user", "n"),
    ]
    df = spark.createDataFrame(rows, chat.EVENTS)
    made = chat.format_log(df).orderBy("conv_id", "position").collect()
    text = "".join(r["segment"] for r in made if r["conv_id"] == 1)
    assert chat.parse(text) == [("user", "a\\<s>[b"), ("assistant", "fin"), ("", ""), ("tool]", "t")]
    assert [r["segment"] for r in made if r["conv_id"] is None] == ["[INST] n [/INST]"]
    assert chat.digests(chat.format_log(df.limit(0))).count() == 0


def test_topk_widths_and_repeats(spark):
    """Vectors of several widths, rows and queries that come twice, one id with two vectors, many small groups."""
    import random

    pick = random.Random(2)
    rows = [(i, [pick.randrange(-9, 9) for _ in range(3 + i % 2)]) for i in range(300)]
    rows += [rows[20], rows[40], (60, [1, 2, 3]), (None, [1, 2, 3]), (80, None), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, q array<long>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, df.where("vec_id % 20 = 0"), k=5, query_group=4, row_group=50).collect())
    whole = [(i, tuple(v)) for i, v in rows if i is not None and v is not None]
    want = []
    for q, a in sorted({(i, v) for i, v in whole if i % 20 == 0}):
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(b) == len(a))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_chat_log_folds_back(spark):
    """A log of whole, streamed, edited and regenerated messages folds back to its rows, repeated rows included."""
    rows = [(c, t, r, x) for c in (1, 2, None) for t in range(40) for r, x in [("user", f"q{t} \\[INST] ünï"), ("assistant", "a" * t)]] + [(1, 3, "assistant", "aaa"), (2, None, None, None), (2, 5, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.conversation_events(df)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] == len(rows)
    got = sorted(((r["conv_id"], r["position"]["message"], *chat.parse(r["segment"])[0]) for r in chat.format_log(log).collect()), key=str)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)


def test_mixing_clashing_columns(spark):
    """Columns with the names of added and of inner columns: added ones are replaced, the others stay."""
    names = ["rows", "w0", "w1", "_start", "_key", "s", "doc", "part", "n", "start", "copies", "Size", "at_word", "row", "due", "copy", "key"]
    df = spark.createDataFrame([(i, "w " * i, f"s{i % 3}", *range(len(names))) for i in range(20)], ["doc_id", "text", "source", *names])
    mixed = mixing.mix(df)
    assert {c for c in names if c not in mixed.columns} == {"Size"} and mixed.count() == 20
    order = mixing.curriculum(mixed).collect()
    assert order and all(r["rows"] == 0 and r["key"] == len(names) - 1 for r in order)
    at = [r["at_word"] for r in order]
    assert at == sorted(at)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}


def test_stages_on_odd_rows(spark, odd, labels, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows and ids, and on no rows; two texts under one id both stay."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.select(*corpus_pipeline.COLUMNS).union(spark.createDataFrame([(4, "another text under one id", "en", "s1", 25)], "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        assert name == "best_fit_packing" or made.columns == corpus_pipeline.COLUMNS
        rows = made.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "simhash_near_dedup":
            kept = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in rows)
            assert kept == [(0, 23), (1, 0), (4, 7), (4, 25), (5, len(LONG)), (8, len(TEXTS[8][1])), (9, 5000)]


def test_pipeline_stages(spark, sf_dir):
    """Each stage against its plain version on the rows that the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mix_to_weights", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    judged = toxicity.score_toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    one = stage["toxicity"](spark, docs, sf_dir)
    assert one.columns == corpus_pipeline.COLUMNS
    assert {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in judged.where("predicted = 0").select("doc_id").collect()}
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    place = {d: i for i, (d, _) in enumerate(rows)}
    bits = [(place[c], place[d]) for d, (_, c) in brute.simhash_components(rows).items()]
    low = brute.components(len(rows), bits + near_pairs([shingles(t) for _, t in rows]))  # the stage's rule: 4 bits, or five words at 0.8
    two = stage["simhash_near_dedup"](spark, docs, sf_dir)
    assert {r[0] for r in two.select("doc_id").collect()} == {rows[i][0] for i, c in enumerate(low) if i == c}
    three = stage["suffix_array_dedup"](spark, two, sf_dir)
    held = two.select("doc_id", "text").collect()
    left = {r[0]: w for r, w in zip(held, brute.repeats([r[1] for r in held]))}
    got = {r[0]: r[1] for r in three.select("doc_id", "text").collect()}
    for d, (_, gone, _, kept) in left.items():
        if gone == 0:
            assert got[d].encode() == kept
        elif d in got:
            assert got[d] == kept.decode(errors="ignore")
    four = stage["mix_to_weights"](spark, three, sf_dir)
    mixed = mixing.mix(three).agg(F.sum("copies")).first()[0]
    assert four.columns == corpus_pipeline.COLUMNS and four.count() == mixed
    five = stage["best_fit_packing"](spark, four, sf_dir).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert five.where("n > 1024").count() == 0

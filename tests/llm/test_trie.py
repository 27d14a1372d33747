"""The conversation trie against a plain one, with buckets of a few rows so that levels, paths and local parts all come up."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from strandline.llm import trie

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Sorted node rows of (conv_id, turn, role, text) by walking every prefix."""
    original = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            original[conv].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    original = {c: [x for _, x in sorted(t)] for c, t in original.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(original):
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = tuple(original.get(base, [])[:h] + original[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    out = []
    for node, held in members.items():
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, pos long, words long, bucket string, stop string")


def nodes(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, local", [(1, 2), (2, 6), (3, 40), (4, 100000)])
def test_random_conversations(spark, seed, local):
    """Few distinct turns and forced copies make a bushy trie; some bases are missing, ids are negative too."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 140), 90):
        texts = [f"{rng.choice('ab')} {'w ' * rng.randrange(3)}" for _ in range(rng.choice((1, 2, 3, 5, 9)))]
        texts = ["same start", "b"] * 4 if rng.random() < 0.2 else texts
        rows += [(c, t, rng.choice(("user", "user", "assistant")) if seed % 2 else "user", x) for t, x in enumerate(texts)]
    assert nodes(trie.conversation_trie(frame(spark, rows), local)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 3, None, None), (0, 3, "user", "tie"), (0, 3, "user", "tie"), (0, 1, "", ""), (None, 0, "user", "nobody"),
        (1, 0, "user", "a"), (2, 5, "user", "long " * 5000), (7, 0, "u", "ser"), (7, 1, "us", "er"), (40, 0, "user", "alone"), (43, 0, "user", "x y z \x0bq"),
    ]
    for local in (1, 3, 1000):
        assert nodes(trie.conversation_trie(frame(spark, rows), local)) == plain(rows)
    assert nodes(trie.conversation_trie(frame(spark, rows).limit(0))) == []
    assert nodes(trie.conversation_trie(frame(spark, [(None, 0, "user", "x")]))) == []


def test_long_copies_take_few_levels(spark, monkeypatch):
    """Long conversations that run together for hundreds of turns, with stretches of a few positions; one lone long one."""
    monkeypatch.setattr(trie, "STRETCH", 16)
    long = [("user", f"turn {i}") for i in range(300)]
    rows = [(c, t, r, x) for c in (0, 1, 2, 3) for t, (r, x) in enumerate(long[: 300 - 50 * (c == 2)] + [("user", "end")] * (c == 3))]
    rows += [(60, t, "user", f"other {t}") for t in range(200)]
    assert nodes(trie.conversation_trie(frame(spark, rows), 20)) == plain(rows)


def test_one_conversation(spark):
    rows = [(20, t, "user", f"t{t}") for t in range(50)]
    for local in (10, 1000):
        assert nodes(trie.conversation_trie(frame(spark, rows), local)) == plain(rows)


def test_query(spark, sf_dir):
    from strandline.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op12_conversation_prefix_trie"](spark, sf_dir)) == plain(rows)

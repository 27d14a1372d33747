"""The merge scan finds neighbours in byte order, level by level, whatever order the rows come in."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandline.llm import suffixes


def test_merge_scan(spark):
    pick = random.Random(6)
    heads = [bytes(pick.choice((0, 97, 98, 255)) for _ in range(32)) for _ in range(200)]
    heads += [h[:20] + bytes(12) for h in heads[:80]] + [h[:16] + h[:16] for h in heads[:40]]
    lists = [[(h[:16], h, pick.randrange(9), 1) for h in pick.choices(heads, k=150)] for _ in range(3)]
    frames = [spark.createDataFrame(rows, "lead binary, head binary, cover long, n long").groupBy("lead", "head", "cover").agg(F.sum("n").alias("n")) for rows in lists]
    got = {bytes(r["head"]) for r in suffixes.IndexFamily.merge_scan(frames[0], frames[1:]).collect()}
    own, old = Counter(r[1] for r in lists[0]), {r[1] for rows in lists[1:] for r in rows}
    assert got == {h for h, n in own.items() if n > 1 or h in old}


def test_level_in_byte_order(spark):
    """A level's neighbours that share a head are found by one pass over its files as they lie, and by none over shuffled rows."""
    pick = random.Random(7)
    rows = [(bytes(pick.choice(b"ab") for _ in range(4)) * 4 + bytes([pick.choice(b"ab")]) * 16, pick.randrange(1 << 40)) for _ in range(400)]
    family = suffixes.IndexFamily()
    family.add(spark.createDataFrame(rows, "head binary, cover long"))
    level = family.levels[0][1].withColumn("file", F.input_file_name()).collect()
    runs = lambda held: sum(a["head"] != b["head"] or a["file"] != b["file"] for a, b in zip(held, held[1:])) + 1
    by_file = sorted(level, key=lambda r: r["file"])
    assert runs(by_file) == len({h for h, _ in rows})
    for name in {r["file"] for r in level}:
        held = [bytes(r["head"]) for r in level if r["file"] == name]
        assert held == sorted(held)
    pick.shuffle(level)
    assert runs(level) > 2 * len({h for h, _ in rows})
    family.drop()

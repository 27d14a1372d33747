"""Many hashes at once against the hash of each text."""

import hashlib

import numpy as np

from strandline.functions.draws import draw_heads, units_of


def test_heads_are_those_of_the_texts():
    draws = np.array([1, 9, 10, 99, 100, 2000])
    items = ["0", "7|1", "12345|67", "é|3", "-4|" + "9" * 30, "x" * 60, *map(str, range(40))]
    got = draw_heads(42, draws, items, block=16)
    for d, row in zip(draws, got.tolist()):
        for item, head in zip(items, row):
            text = hashlib.md5(f"42|{d}|{item}".encode()).hexdigest()
            assert head == int(text[:16], 16)
            assert units_of(np.array([head], np.uint64))[0] == int(text[:13], 16) / 2**52
    assert draw_heads(1, draws, []).shape == (6, 0)

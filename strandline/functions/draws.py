"""Deterministic random draws: the same text gives the same number in every engine."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hex(seed: int, *keys: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1) from the first 13 hex digits."""
    return F.conv(F.substring(draw_hex(seed, *keys), 1, 13), 16, 10).cast("double") / float(1 << 52)


# the same texts hashed many at once, for tasks that need a number for every draw and row

_ROUND = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
_LONGEST = 55  # bytes that fit one block


def _compressed(words: list[np.ndarray]) -> np.ndarray:
    """First 16 hex digits, as numbers, of the MD5 of one-block messages given as 16 arrays of words."""
    n = len(words[0])
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        a += f
        if len(words[g]) == 1:
            a += words[g] + np.uint32(_ROUND[i])
        else:
            a += words[g]
            a += np.uint32(_ROUND[i])
        np.left_shift(a, np.uint32(_TURN[i]), out=t)
        a >>= np.uint32(32 - _TURN[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    both = np.stack([a + np.uint32(_START[0]), b + np.uint32(_START[1])], axis=1)
    return both.view(">u8").ravel().astype(np.uint64)


def _words(texts: list[bytes], before: int, end: bool) -> np.ndarray:
    """(16, texts): words of blocks that hold texts of one length from the byte `before`; with the end mark and the length in bits."""
    total = before + len(texts[0])
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, before:total] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    if end:
        block[:, total] = 128
        block[:, 56:64] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
    return block.view("<u4").astype(np.uint32).T.copy()


def draw_heads(seed: int, draws: np.ndarray, items: list[str], block: int = 16384) -> np.ndarray:
    """(draws, items): the first 16 hex digits of draw_hex(seed, draw, item) as unsigned numbers, items being whole key texts."""
    texts = [i.encode() for i in items]
    heads = [f"{seed}|{int(d)}|".encode() for d in draws]
    out = np.zeros((len(heads), len(texts)), np.uint64)
    head_size, text_size = np.array([len(h) for h in heads]), np.array([len(x) for x in texts])
    for m in np.unique(head_size):
        rows = np.flatnonzero(head_size == m)
        left = _words([heads[r] for r in rows], 0, False)
        for n in np.unique(text_size):
            columns = np.flatnonzero(text_size == n)
            if m + n > _LONGEST:
                for r in rows:
                    out[r, columns] = [int.from_bytes(hashlib.md5(heads[r] + texts[c]).digest()[:8], "big") for c in columns]
                continue
            right = _words([texts[c] for c in columns], int(m), True)
            step = max(1, block // len(columns))
            for i in range(0, len(rows), step):
                for j in range(0, len(columns), block):
                    here, there = left[:, i : i + step], right[:, j : j + block]
                    shape = here.shape[1], there.shape[1]
                    whole = [there[w, :1] if 4 * w >= m + n + 1 else (here[w][:, None] | there[w][None]).ravel() for w in range(16)]
                    out[np.ix_(rows[i : i + step], columns[j : j + block])] = _compressed(whole).reshape(shape)
    return out


def units_of(heads: np.ndarray) -> np.ndarray:
    """The numbers that `uniform` makes of these hashes."""
    return (heads >> np.uint64(12)).astype(np.float64) / float(1 << 52)

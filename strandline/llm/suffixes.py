"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every `length`-byte window has an anchor: the start of the 32-byte string of least hash within it. Equal windows have
their anchor at the same place, so suffixes that start at anchors are enough. A batch's suffix array holds its
anchored suffixes as their first 32 bytes, the head, in byte order, each with a hash of all bytes that its windows
cover. It stands in buckets of the first 16 bytes, so suffixes that agree in these are neighbours in one bucket. A new
batch is merged in byte order with the levels that stand when it arrives, and a suffix whose neighbour in that order
shares its whole head is a match. Levels of equal size merge, so a suffix is rewritten a logarithmic number of times;
buckets meet in place, without a shuffle. Suffixes that agree in the head and then part are compared in stretches of
neighbouring windows, and only stretches whose common bytes stand twice are compared window by window. Heads are
compared as bytes; covers, only among those of one head, and stretches by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import bucketed, drop_bucketed, drop_path, row_chunks, saved, table, text_or_empty, texts_as_bytes, written

HEAD = 32
LEAD = 16
_PLACES = 23
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0x2545F4914F6CDD1D
_BACK = pow(_STEP, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX[0])


class Hashes:
    """Hashes of all strings of 8, 32, ... bytes of a run of bytes, by doubling: a product, a sum and a shifted xor a step."""

    def __init__(self, data: np.ndarray) -> None:
        self.by = {1: _BYTE[data]}
        self.n = len(data)

    def of(self, size: int) -> np.ndarray:
        """hash[i] of data[i : i + size] for a power of two; shorter than the data by size - 1."""
        if size not in self.by:
            half = self.of(size // 2)
            out = half[: max(0, len(half) - size // 2)] * _MIX[size.bit_length() % 3]
            out += half[size // 2 :]
            out ^= out >> np.uint64(30)
            self.by[size] = out
        return self.by[size]

    def windows(self, starts: np.ndarray, length: int, salt: int) -> np.ndarray:
        """Hash of data[s : s + length] for every start, from the powers of two that make up the length."""
        out = np.full(len(starts), np.uint64(salt), np.uint64)
        at, rest = starts.copy(), length
        while rest:
            size = 1 << (rest.bit_length() - 1)
            out = _mixed(out * _MIX[0] + self.of(size)[at])
            at, rest = at + size, rest - size
        return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    low, have = keys, 1
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(texts: list[bytes], length: int = 200) -> tuple[np.ndarray, ...]:
    """(text index, first and last window start, anchor, head bytes, cover hash) of every anchored suffix of the texts.

    A window never leaves its text. The cover hash is of the bytes from the first window's start to the last
    window's end and of the anchor's place in them. Longer texts than 128 KB, whose hashes a core's cache holds, are cut
    into spans that overlap by a window.
    """
    span = 1 << 17
    pieces, of, base = [], [], []
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), span):
            if len(t) - s >= length:
                pieces.append(t[s : s + span + length - 1])
                of.append(i)
                base.append(s)
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    group: list[int] = []
    size = 0
    for n, piece in enumerate([*pieces, None]):
        if group and (piece is None or size + len(piece) > span):
            for k, x in enumerate(_anchors_of([pieces[g] for g in group], np.array([of[g] for g in group]), np.array([base[g] for g in group]), length)):
                found[k].append(x)
            group, size = [], 0
        if piece is not None:
            group.append(n)
            size += len(piece)
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros((0, HEAD), np.uint8), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in found) if found[0] else empty


def _anchors_of(pieces: list[bytes], of: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    hashes = Hashes(data)
    head = hashes.of(HEAD)
    keys = head * _MIX[0]
    keys &= ~np.uint64((1 << _PLACES) - 1)
    keys |= np.arange(len(head), dtype=np.uint64)
    least = _least(keys, length - HEAD + 1)
    inside = np.ones(len(least) + 1, bool)
    for e in ends.tolist():  # windows that leave their piece
        inside[e - length + 1 : e] = False
    inside[-1] = False
    turn = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=turn[1:-1])
    turn[1:] |= ~inside[:-1]
    a = np.flatnonzero(inside & turn)
    b = np.flatnonzero(inside[:-1] & (turn[1:] | ~inside[1:]))
    p = (least[a] & np.uint64((1 << _PLACES) - 1)).astype(np.int64)
    piece = np.searchsorted(ends, a, side="right")
    grams = hashes.of(8)
    up = np.cumsum(grams * _powers(_STEP, len(grams)))
    total = np.r_[np.uint64(0), up]
    cover = (total[b + length - 7] - total[a]) * _powers(_BACK, len(grams) + 1)[a]
    cover = _mixed(cover ^ _mixed(((p - a).astype(np.uint64) << np.uint64(32)) | (b - a).astype(np.uint64)))
    shift = base[piece] - (ends - sizes)[piece]
    return of[piece], a + shift, b + shift, p + shift, np.lib.stride_tricks.sliding_window_view(data, HEAD)[p], cover


def _key(doc_id: str = "doc_id") -> Column:
    """The document's id, with a number of its own for null."""
    return F.coalesce(F.col(doc_id), F.lit(-(2**63)))


def _keyed(documents: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, str, str]:
    """A bucketed table (k, h, doc_id, text and the carried columns as _name): k and h tell the texts apart."""
    text = text_or_empty().cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    return bucketed(rows.withColumn("k", _key()), "suffix-texts", ["k", "h"], ["k", "h"])


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a matrix of bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def anchored_suffixes(texts: DataFrame, batches: int, length: int) -> DataFrame:
    """(batch, head, cover, k, h, a, b, p): all anchored suffixes of texts (k, h, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(rows, 1024, 1 << 20):
            text, a, b, p, head, cover = anchors(texts_as_bytes(batch.column(2)), length)
            pick = pa.array(text)
            h = batch.column(1).take(pick)
            yield pa.RecordBatch.from_arrays(
                [pa.array((h.to_numpy() % batches).astype(np.int32)), _binary(head), pa.array(cover.view(np.int64)), batch.column(0).take(pick), h, *(pa.array(x.astype(np.int32)) for x in (a, b, p))],
                names=["batch", "head", "cover", "k", "h", "a", "b", "p"],
            )

    return texts.select("k", "h", "text").mapInArrow(run, "batch int, head binary, cover long, k long, h long, a int, b int, p int")


class IndexFamily:
    """Levels of suffix arrays (lead, head, cover, n) in byte order in buckets of lead; sizes double, equal sizes merge.

    `twice` lists, for each batch added, the heads that came twice with it: within the batch, or in it and in a level
    that stood when it arrived. Any two batches meet that way, so the lists together hold every repeated head.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame, str, str]] = []
        self.twice: list[tuple[DataFrame, str, str]] = []

    @staticmethod
    def _array(rows: DataFrame) -> tuple[DataFrame, str, str]:
        summed = rows.groupBy("head", "cover").agg(F.count(F.lit(1)).alias("n"))
        return bucketed(summed.select(F.substring("head", 1, LEAD).alias("lead"), "head", "cover", "n"), "suffix-level", ["lead"], ["lead", "head", "cover"])

    @staticmethod
    def _merged(one: DataFrame, other: DataFrame) -> tuple[DataFrame, str, str]:
        summed = one.unionByName(other).groupBy("lead", "head", "cover").agg(F.sum("n").alias("n"))
        return bucketed(summed, "suffix-level", ["lead"], ["lead", "head", "cover"], in_place=True)

    @staticmethod
    def merge_scan(fresh: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """(lead, head) of the fresh suffixes that come more than once or whose neighbour before, in the byte order of
        all, shares their head; among equal heads those of the levels stand first."""
        every = fresh.select("lead", "head", "n", F.lit(1).alias("new"))
        for level in levels:
            every = every.unionByName(level.select("lead", "head", "n", F.lit(0).alias("new")))
        order = Window.partitionBy("lead").orderBy("head", "new")
        met = (F.col("n") > 1) | F.coalesce(F.lag("head").over(order) == F.col("head"), F.lit(False))
        return every.withColumn("met", met).where("new = 1 and met").select("lead", "head").distinct()

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Make the batch's suffix array, merge-scan it against the levels and merge levels of equal size, from the
        smallest; the heads (lead, head) that come twice since this batch. A level that has been merged is deleted."""
        size, made = 1, self._array(suffixes)
        self.twice.append(bucketed(self.merge_scan(made[0], [level for _, level, *_ in self.levels]), "suffix-twice", ["lead"], ["lead", "head"]))
        while self.levels and self.levels[-1][0] == size:
            _, *other = self.levels.pop()
            merged, size = self._merged(other[0], made[0]), size * 2
            for gone in (other, made):
                drop_bucketed(suffixes.sparkSession, *gone[1:])
            made = merged
        self.levels.append((size, *made))
        return self.twice[-1][0]

    def long_matches(self) -> DataFrame:
        """(head, cover, n, mixed): the suffixes whose head comes twice or more over all levels.

        The lists of `twice` are merged in byte order with the levels, a list's head before the suffixes that start
        with it. mixed: a neighbour shares the head, so the head stands in suffixes whose covered bytes differ.
        """
        every = None
        for _, level, *_ in self.levels:
            every = level if every is None else every.unionByName(level)
        for heads, *_ in self.twice:
            every = every.unionByName(heads.select("lead", "head", F.lit(None).cast("long").alias("cover"), F.lit(0).cast("long").alias("n")))
        every = every.groupBy("lead", "head", "cover").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("lead").orderBy(F.col("head"), F.col("cover").asc_nulls_first())
        listed = F.last(F.when(F.col("cover").isNull(), F.col("head")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        before = F.lag(F.when(F.col("cover").isNotNull(), F.col("head"))).over(order) == F.col("head")
        after = F.lead("head").over(order) == F.col("head")
        mixed = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
        return every.withColumn("listed", listed).withColumn("mixed", mixed).where("cover is not null and listed = head").select("head", "cover", "n", "mixed")

    def drop(self) -> None:
        for made in [level[1:] for level in self.levels] + self.twice:
            drop_bucketed(made[0].sparkSession, *made[1:])


def _pieces_of(data: bytes, a: np.ndarray, b: np.ndarray, p: np.ndarray, width: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(span, common hash, whole hash, first start, last start) of the stretches of the spans' starts a..b.

    A stretch holds up to `width` starts, counted back from the anchor p. All its windows have the bytes of the
    common hash; the whole hash is of everything they cover.
    """
    order = np.argsort(a, kind="stable")
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(a[order], a[order[at]] + (1 << 20))))
        part = order[at:to]
        at = to
        lo, hi = int(a[part].min()), int(b[part].max()) + length
        hashes = Hashes(np.frombuffer(data[lo:hi], np.uint8))
        low, high = (p[part] - b[part]) // width, (p[part] - a[part]) // width
        count = high - low + 1
        row = np.repeat(np.arange(len(part)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
        common = p[part][row] - width * k
        first, last = np.maximum(a[part][row], common - width + 1), np.minimum(b[part][row], common)
        whole = _mixed(hashes.windows(first - lo, length, 2) * _MIX[0] + hashes.windows(last - lo, length, 3) + (last - first).astype(np.uint64))
        yield part[row], hashes.windows(common - lo, length - width + 1, 1), whole, first, last


def stretches(texts: DataFrame, asked: DataFrame, width: int, length: int) -> DataFrame:
    """(common, whole, k, h, a, b, p, open) of the asked suffixes' stretches of up to `width` windows."""
    lists = asked.distinct().groupBy("k", "h").agg(F.collect_list(F.struct("a", "b", "p", "open")).alias("asked"))
    found = texts.select("k", "h", "text").join(lists, ["k", "h"]).select("k", "h", "text", "asked")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(rows, 128, 1 << 20):
            asked_of = batch.column(3)
            flat, ends = asked_of.flatten(), asked_of.offsets.to_numpy() - asked_of.offsets[0].as_py()
            a, b, p = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            is_open = flat.field(3).to_numpy(zero_copy_only=False)
            for i, data in enumerate(texts_as_bytes(batch.column(2))):
                own = slice(ends[i], ends[i + 1])
                for span, common, whole, first, last in _pieces_of(data, a[own], b[own], p[own], width, length):
                    same = pa.array(np.full(len(span), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(common.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(same), batch.column(1).take(same), *(pa.array(x.astype(np.int32)) for x in (first, last, p[own][span])), pa.array(is_open[own][span])],
                        names=["common", "whole", "k", "h", "a", "b", "p", "open"],
                    )

    return found.mapInArrow(run, "common long, whole long, k long, h long, a int, b int, p int, open boolean")


def _told_apart(rows: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """The open rows that stand twice, and those to compare further: rows that share `first` but not `second`.

    Of equal rows one goes on as a witness (not open) for the others that share `first`.
    """
    twice = rows.where("n > 1 and open").select("k", "h", "a", "b")
    alone = rows.where("n = 1 and mixed").select("k", "h", "a", "b", "p", "open")
    one = rows.where("n > 1 and mixed").groupBy(first, second).agg(F.min(F.struct("k", "h", "a", "b", "p")).alias("w"))
    return twice, alone.unionByName(one.select("w.*", F.lit(False).alias("open")))


def repeated_starts(texts: DataFrame, length: int = 200, batches: int = 3, width: int = 24) -> DataFrame:
    """(k, h, a, b): runs of starts a..b whose `length`-byte windows also start anywhere else, from texts (k, h, text)."""
    spark = texts.sparkSession
    suffixes, path = saved(anchored_suffixes(texts, batches, length), "suffixes", ["batch"])
    family = IndexFamily()
    for n in range(batches):
        family.add(suffixes.where(F.col("batch") == n))
    hit = written(suffixes.drop("batch").join(family.long_matches(), ["head", "cover"]).withColumn("open", F.lit(True)), "suffix-hits")
    drop_path(spark, path)
    family.drop()
    found, asked = _told_apart(hit, "head", "cover")
    for step in (width, 1):
        parts, path = saved(stretches(texts, asked, step, length), f"suffix-stretches-{step}")
        keys = parts.groupBy("common", "whole").agg(F.count(F.lit(1)).alias("n"))
        shared = keys.groupBy("common").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
        known = keys.join(shared, "common").select("common", "whole", "n", (F.col("kinds") > 1).alias("mixed"))
        rows = written(parts.join(known, ["common", "whole"]), f"suffix-shared-{step}")
        drop_path(spark, path)
        twice, asked = _told_apart(rows, "common", "whole")
        found = found.unionByName(twice)
    return found


def kept_bytes(data: bytes, spans: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of removed runs; spans are rows of window starts a, b."""
    if not len(spans):
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1] + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(documents: DataFrame, length: int = 200, batches: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, kept binary, n_bytes, n_removed, n_spans, and the columns in `carry`.

    Every byte covered by a `length`-byte string that also starts anywhere else goes, whichever document or batch
    holds the other place; strings are judged on the input. Null texts are empty; texts shorter than `length` stay
    whole; repeated rows repeat each other; no rows give no rows; other columns are not read.
    """
    texts = _keyed(documents, carry)[0]
    starts = repeated_starts(texts, length, batches)
    lists = starts.groupBy("k", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = texts.join(lists, ["k", "h"], "left").select("doc_id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"), *[f"_{c}" for c in carry])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches_, 512, 2 << 20):
            out = []
            for data, a, b in zip(texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans = np.array([a, b], np.int64).T if a else np.zeros((0, 2), np.int64)
                out.append((*kept_bytes(data, spans, length), len(data)))
            kept, gone, runs, size = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), *batch.columns[4:]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", *(f"_{c}" for c in carry)])

    kinds = dict(documents.dtypes)
    out = rows.mapInArrow(run, ", ".join(["doc_id long, kept binary, n_bytes long, n_removed long, n_spans long", *(f"`_{c}` {kinds[c]}" for c in carry)]))
    return out.withColumnsRenamed({f"_{c}": c for c in carry})


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

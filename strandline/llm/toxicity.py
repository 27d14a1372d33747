"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Two sentences are alike when they share subsequences of three characters, each gap in them weighing less, so an insult
with inserted, dropped or doubled characters stays near to its plain form. The machine is trained on labelled sentences:
those of clean documents, and those of toxic documents that hold a word which toxic documents have beyond chance. It
sees them by their kernel values with landmark sentences; the kernel's feature map is written out over hashed
subsequences, so the trained machine becomes one weight a hashed subsequence and scores any sentence without a landmark
being formed. A text is scored by its most telling sentence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import row_chunks, table, text_or_empty, written

BITS = 18
REACH = 3  # a subsequence's next character lies at most so far on: two inserted characters pass
DECAY = 0.6
LONGEST, OVERLAP = 48, 20  # a longer sentence is read in overlapping windows
EDGE = ".,;:!?\"'()[]{}<>*_~`«»“”„¡¿…-%&#$"
THRESHOLD = 0.3
SHARES = 1 << 20
_STEPS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]
_NEWLINE, _STOP, _WHITE = 1, 2, 4
_CLASS = np.zeros(128, np.uint8)
_CLASS[[ord(c) for c in ".!?,;:"]] = _STOP
_CLASS[[9, 11, 12, 13, 32]] = _WHITE
_CLASS[10] = _NEWLINE | _WHITE
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _norm(size: np.ndarray) -> np.ndarray:
    """Square root of the summed squared weights of all subsequences of a sentence of that size; 1 where there are none."""
    total = sum(DECAY ** (2 * (a + b - 2)) * np.maximum(size - a - b, 0) for a, b in _STEPS)
    return np.sqrt(np.where(total > 0, total, 1.0))


def sentence_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, size of each sentence, text of each sentence) of the lower-cased texts, sentence after sentence.

    A sentence ends at a line break or at one of .!?,;: before white space, which stands in it as its last space; other
    white space is a space, and a sentence begins with one. Sentences of white space alone are left out; longer ones
    than LONGEST come as windows.
    """
    marked = [" " + t.lower().replace("\n", "\n ") + "\n" for t in texts]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(code, 127)]
    stop = (kind & _NEWLINE) > 0
    stop[:-1] |= (kind[:-1] == _STOP) & ((kind[1:] & _WHITE) > 0)
    code = np.where(stop | ((kind & _WHITE) > 0), np.uint32(32), code)
    ends = np.flatnonzero(stop) + 1
    starts = np.r_[0, ends[:-1]]
    of = np.searchsorted(np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked))), starts, side="right")
    there = np.add.reduceat(code != 32, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    starts, sizes, of = starts[there], (ends - starts)[there], of[there]
    step = LONGEST - OVERLAP
    windows = np.where(sizes > LONGEST, -(-(sizes - OVERLAP) // step), 1)
    row = np.repeat(np.arange(len(sizes)), windows)
    begin = starts[row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * step
    size = np.minimum(LONGEST, starts[row] + sizes[row] - begin)
    take = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    return code[take], size, of[row]


def sentences(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The sentences as strings, and the text of each."""
    code, size, of = sentence_codes(texts)
    whole, ends = code.tobytes().decode("utf-32-le", "surrogatepass"), np.cumsum(size)
    return [whole[i:j] for i, j in zip((ends - size).tolist(), ends.tolist())], of


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, lines), np.int64, len(lines))


def _subsequences(code: np.ndarray, size: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, hash bucket at each place, places whose subsequence leaves its sentence) for each way to step."""
    first, second, third = (code * m for m in _MIX[:3])
    ends = np.cumsum(size)
    tails = [(ends - r)[size >= r] for r in range(1, 2 * REACH + 1)]
    for a, b in _STEPS:
        n = len(code) - a - b
        if n <= 0:
            continue
        h = first[:n] + second[a : a + n]
        h += third[a + b :]
        h ^= h >> np.uint32(15)
        h *= _MIX[3]
        h >>= np.uint32(32 - BITS)
        out = np.concatenate(tails[: a + b])
        yield DECAY ** (a + b - 2), h, out[out < n]


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, bucket, weight) of all gapped three-character subsequences, over the square root of the summed squares."""
    code, size = _codes(lines)
    of = np.repeat(np.arange(len(lines)), size)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for weight, bucket, out in _subsequences(code, size):
        inside = np.ones(len(bucket), bool)
        inside[out] = False
        at = np.flatnonzero(inside)
        found.append((of[at], bucket[at].astype(np.int64), np.full(len(at), weight)))
    s, b, x = (np.concatenate([f[i] for f in found]) for i in range(3))
    return s, b, x / _norm(size)[s]


def kernel(left: list[str], right: list[str], block: int = 128) -> np.ndarray:
    """Kernel values of sentences with landmarks, by way of the hashed map; only a block of landmarks is written out at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    for s in range(0, len(right), block):
        rs, rb, rx = features(right[s : s + block])
        there, column = np.unique(rb, return_inverse=True)
        held = np.zeros((len(there), len(right[s : s + block])), np.float32)
        np.add.at(held, (column, rs), rx)
        for i in range(0, len(left), 256):
            ls, lb, lx = features(left[i : i + 256])
            at = np.searchsorted(there, lb)
            both = at < len(there)
            both[both] = there[at[both]] == lb[both]
            dense = np.zeros((len(left[i : i + 256]), len(there)), np.float32)
            np.add.at(dense, (ls[both], at[both]), lx[both])
            out[i : i + 256, s : s + held.shape[1]] = dense @ held
    return out


@dataclass
class Model:
    """A weight for each hashed subsequence, an offset, and the slope and offset that turn a margin into a probability."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The machine's value for each sentence."""
        if not len(size):
            return np.zeros(0)
        total = np.zeros(len(code), np.float32)
        for weight, bucket, out in _subsequences(code, size):
            value = self.weights[bucket]
            value[out] = 0
            value *= np.float32(weight)
            total[: len(value)] += value
        return np.add.reduceat(total, np.cumsum(size) - size, dtype=np.float64) / _norm(size) + self.offset

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """The largest margin of each text's sentences; NaN for a text without any."""
        code, size, of = sentence_codes(texts)
        out = np.full(len(texts), np.nan)
        if len(of):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[first]] = np.maximum.reduceat(self.margins(code, size), first)
        return out


def _nothing(shift: float) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, shift)


def _svm(x: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 40, part_rows: int = 256) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps on the margin violators; the last weight is the offset.

    The rows of `x` come in parts, of which `part_rows` become doubles at a time.
    """
    size = x[0].shape[1] + 1
    w, ridge = np.zeros(size), np.eye(size)
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        square, right = ridge.copy(), np.zeros(size)
        s = 0
        for part in (p[i : i + part_rows] for p in x for i in range(0, len(p), part_rows)):
            here, s = slice(s, s + len(part)), s + len(part)
            own = np.c_[part.astype(np.float64), np.ones(len(part))]
            active = y[here] * (own @ w) < 1
            own = own[active]
            scaled = own * cost[here][active, None]
            square += scaled.T @ own
            right += scaled.T @ y[here][active]
        new = np.linalg.solve(square, right)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _variants(lines: list[str], telling: list[str]) -> list[str]:
    """A virtual example of each sentence: its telling word with a mark between all characters, or with one foreign
    character put in or in place."""
    out = []
    for n, (line, w) in enumerate(zip(lines, telling)):
        mark, at = ".-*_ "[n % 5], 1 + n % max(1, len(w) - 1)
        changed = [mark.join(w), w[:at] + mark + w[at:], w[:at] + "*x1#"[n % 4] + w[at + 1 :]][n % 3]
        out.append(line.replace(w, changed, 1))
    return out


def _fit(spark: SparkSession, positive: list[str], changed: list[str], negative: list[str], landmarks: list[str]) -> Model:
    """The machine on Nyström features of the landmarks, which come from tasks as half-precision numbers, a row a training sentence."""
    own = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-5 * value.max()
    half = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 2048):
            x = (kernel(batch.column(1).to_pylist(), landmarks) @ half).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["n", "x"])

    lines = positive + changed + negative
    frame = spark.createDataFrame(pa.table({"n": np.arange(len(lines)), "line": lines})).repartition(max(2, spark.sparkContext.defaultParallelism), "n")
    rows = frame.mapInArrow(run, "n long, x binary").toArrow()
    n = rows.column("n").to_numpy()
    x = [np.frombuffer(c.buffers()[2], np.float16, len(c) * half.shape[1]).reshape(len(c), -1) for c in rows.column("x").chunks if len(c)]
    y = np.r_[np.ones(len(positive) + len(changed)), -np.ones(len(negative))]
    lift = max(1.0, len(negative) / len(positive)) / 4
    cost = np.r_[np.full(len(positive), 10.0 * lift), np.full(len(changed), 2.5 * lift), np.full(len(negative), 10.0)]
    found = _svm(x, y[n], cost[n])
    del rows, x
    s, b, w = features(landmarks)
    return Model(np.bincount(b, (half @ found[:-1])[s] * w, 1 << BITS).astype(np.float32), float(found[-1]), 1.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words_of(rows: DataFrame, with_neighbour: bool) -> DataFrame:
    """(word[, before]) for every place of a word in the lower-cased texts, without punctuation at its edges."""
    words = F.split(F.lower("text"), r"\s+")
    if with_neighbour:
        pairs = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("before"))
        each = rows.select(F.explode(pairs).alias("p")).select(F.col("p.w").alias("w"), F.col("p.before").alias("before"))
    else:
        each = rows.select(F.explode(words).alias("w"))
    out = each.withColumn("word", F.btrim("w", F.lit(EDGE))).where("length(word) > 1")
    return out.select("word", "before") if with_neighbour else out.select("word")


def telling_words(rows: DataFrame) -> DataFrame:
    """(word) that stand in toxic rows (toxic, text) beyond what chance gives any word of the vocabulary.

    A word counts once for each word before it, so that copies of one text count once; its share in toxic texts is
    held against the share of all words there by a Chernoff bound over the vocabulary.
    """
    toxic = _words_of(rows.where("toxic = 1"), True).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("t"))
    clean = written(_words_of(rows.where("toxic = 0"), False).groupBy("word").agg(F.count(F.lit(1)).alias("c")), "toxicity-clean-words")
    sizes = clean.agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("places")).first()
    in_toxic = toxic.agg(F.sum("t").alias("n")).first()["n"] or 0
    chance = max(in_toxic, 1) / max(1, in_toxic + (sizes["places"] or 0))
    t, c = F.col("t").cast("double"), F.coalesce("c", F.lit(0)).cast("double")
    share = t / (t + c)
    surprise = t * F.log(share / chance) + F.when(c > 0, c * F.log((1 - share) / (1 - chance))).otherwise(0.0)
    odds = share > 4 * chance / (1 + 3 * chance)
    return toxic.join(clean, "word", "left").where(odds & (surprise >= math.log(1 + sizes["words"]) + 2)).select("word")


def _part(rows: DataFrame, key: str, n: int, bound: int, seed: int) -> DataFrame:
    """About `bound` of n rows, by a hash of the key; all of them if they are no more."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(SHARES)) < math.ceil(SHARES * min(1.0, bound / max(1, n))))


def _sentences_of(rows: DataFrame, toxic: int) -> DataFrame:
    """(line) distinct sentences of the rows with that label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 256, 2 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(sentences([t or "" for t in batch.column(0).to_pylist()])[0], pa.string())], names=["line"])

    return rows.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "line string").distinct()


def _line_margins(lines: DataFrame, model: Model) -> DataFrame:
    held = lines.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 4096):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.margins(*_codes(batch.column(0).to_pylist())))], names=["line", "margin"])

    return lines.select("line").mapInArrow(run, "line string, margin double")


def train(documents: DataFrame, labels: DataFrame, label_rows: int = 20000, sentence_rows: int = 5000, n_landmarks: int = 800, rounds: int = 5) -> Model:
    """Fit on labelled rows that are not held out: about `label_rows` of each label, by a hash of the id.

    Four fifths of them give sentences, at most about `sentence_rows` of either label, by hash; in each round the clean
    sentences that the machine takes for toxic join the negatives, as many again at most. The other fifth turns margins
    into probabilities, weighed back to all labelled rows. Two thirds of the landmarks are toxic sentences. Null labels
    are not used. Without toxic labels or telling words the model gives the share of toxic labels.
    """
    spark = documents.sparkSession
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    learnt = marks.where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in learnt.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    base = math.log((n_toxic + 0.01) / (n_clean + 1))
    if not n_toxic:
        return _nothing(base)
    chosen = _part(learnt.where("toxic = 1"), "doc_id", n_toxic, label_rows, 3).union(_part(learnt.where("toxic = 0"), "doc_id", n_clean, label_rows, 3))
    docs = documents.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    fits = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(5)) != 0
    rows = written(docs.join(F.broadcast(chosen), "doc_id").withColumn("fits", fits), "toxicity-train")  # twice label_rows ids at most
    telling = written(telling_words(rows.where("fits")), "toxicity-words")
    words = _sentences_of(rows.where("fits"), 1).select("line", F.explode(F.split("line", " +")).alias("w")).withColumn("word", F.btrim("w", F.lit(EDGE)))
    toxic_lines = written(words.join(telling, "word").groupBy("line").agg(F.min("word").alias("word")), "toxicity-lines")
    clean_lines = written(_sentences_of(rows.where("fits"), 0), "toxicity-clean-lines")
    found = sorted(tuple(r) for r in _part(toxic_lines, "line", toxic_lines.count(), sentence_rows, 4).collect())
    if not found:
        return _nothing(base)
    positive, telling_of = [r[0] for r in found], [r[1] for r in found]
    changed = _variants(positive, telling_of)
    negative = sorted(r[0] for r in _part(clean_lines, "line", clean_lines.count(), sentence_rows, 5).collect())
    if not negative:
        return _nothing(base)
    pick = np.random.default_rng(11)
    some = lambda lines, n: [lines[i] for i in sorted(pick.permutation(len(lines))[:n])]
    hard: list[str] = []
    for n in range(rounds):
        landmarks = some(positive, 2 * n_landmarks // 3) + some(hard or negative, n_landmarks // 3)
        model = _fit(spark, positive, changed, sorted({*negative, *hard}), landmarks)
        if n + 1 < rounds:
            worst = _line_margins(clean_lines, model).where("margin > -1").orderBy(F.desc("margin"), "line").limit(sentence_rows // rounds).collect()
            hard = sorted({*hard, *(r["line"] for r in worst)})
    pairs = margin_rows(rows.where("not fits").select("toxic", "text"), model, "toxic int").toArrow()
    y = pairs.column("toxic").to_numpy().astype(float)
    if not y.any() or y.all():
        return Model(model.weights, model.offset, 1.0, 0.0)
    margin = np.nan_to_num(pairs.column("margin").to_numpy(zero_copy_only=False).astype(float), nan=-4.0)
    weight = np.where(y > 0, max(1.0, n_toxic / label_rows), max(1.0, n_clean / label_rows))
    model.slope, model.shift = _platt(np.clip(margin, -4, 4), y, weight)
    return model


def margin_rows(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    """Appends `margin` (double, null for a text without sentences) to rows whose last column is the text, which goes."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 256, 1 << 20):
            margin = held.value.of_texts([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin, mask=np.isnan(margin))], names=[*batch.schema.names[:-1], "margin"])

    return rows.mapInArrow(run, f"{schema}, margin double")


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit to smoothed labels, by Newton steps with a small ridge."""
    up, down = ((weight * y).sum() + 1) / ((weight * y).sum() + 2), 1 / ((weight * (1 - y)).sum() + 2)
    goal, x, w = np.where(y > 0, up, down), np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (goal - p)) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def score_toxicity(documents: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, and the columns in `carry`) for each row: the probability from the most telling
    sentence of the whole text.

    Null, empty and blank texts have the lowest margin. Repeated rows stay; no rows give no rows.
    """
    kinds = dict(documents.dtypes)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"_{c}") for c in carry], text_or_empty().cast("string").alias("text"))
    margin = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce("margin", F.lit(-4.0))))
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * margin + F.lit(model.shift))))
    schema = ", ".join(["doc_id long", *(f"`_{c}` {kinds[c]}" for c in carry)])
    out = margin_rows(docs, model, schema).select("doc_id", *[F.col(f"_{c}").alias(c) for c in carry], score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

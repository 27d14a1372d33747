"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral gives the source's share of all words, the
share is bounded by what the source may be repeated, and the inverse of the cumulated schedule turns the words that the
source has dealt before a copy, over all that it deals, into the copy's training time. The demand of all sources up to
that time is the word of training at which the copy is due, and the mix is range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_parts, table, written

Schedule = Callable[[int], float | tuple[float, float]]


def cycled_weights(order: int) -> float:
    """Weights 3, 1, 2 in turn over the sources in code point order."""
    return (3.0, 1.0, 2.0)[order % 3]


def ramped_weights(order: int) -> tuple[float, float]:
    """The weights 3, 1, 2 in turn as means of linear ramps: every other source rises from half to one and a half of its
    weight, the others fall."""
    weight = cycled_weights(order)
    return (weight / 2, 1.5 * weight) if order % 2 == 0 else (1.5 * weight, weight / 2)


def word_count(text: str = "text") -> Column:
    r"""Number of `[^\x20\x09-\x0D]+` in a text; null counts 0. Leading, trailing and repeated gaps make no words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, schedule: Schedule = cycled_weights) -> list[dict]:
    """Per source: source, order, source_size, start and end weight, target.

    `sizes` has a row a source (source, source_size). The mix holds `share` of all words, dealt by the integral of
    the schedules; a source over `most` times its size stops there and the excess goes to the others by weight, until
    none is above. Words that no source can take are left out.
    """
    rows = sorted(((r["source"], int(r["source_size"])) for r in sizes.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or ""))
    out = []
    for i, (source, size) in enumerate(rows):
        weight = schedule(i)
        first, last = weight if isinstance(weight, tuple) else (weight, weight)
        out.append({"source": source, "order": i, "source_size": size, "w0": float(first), "w1": float(last), "target": 0.0})
    budget, open_ = share * sum(r["source_size"] for r in out), list(out)
    while open_ and budget > 0:
        total = sum((r["w0"] + r["w1"]) / 2 for r in open_)
        if total <= 0:
            break
        over = [r for r in open_ if budget * (r["w0"] + r["w1"]) / 2 / total > most * r["source_size"]]
        if not over:
            for r in open_:
                r["target"] = budget * (r["w0"] + r["w1"]) / 2 / total
            break
        for r in over:
            r["target"] = most * r["source_size"]
            budget -= r["target"]
        open_ = [r for r in open_ if r not in over]
    return out


def _position(progress: Column) -> Column:
    """Training time at which a linear schedule w0 -> w1 has dealt the share `progress` of its integral."""
    w0, w1 = F.col("w0"), F.col("w1")
    slope = w1 - w0
    root = F.sqrt(w0 * w0 + slope * (w0 + w1) * progress)
    return F.when(F.abs(slope) < 1e-12, progress).otherwise((root - w0) / slope)


MADE = ["size", "source_size", "target", "copies", "taken", "position", "positions", "at_word"]


def mix(documents: DataFrame, share: float = 1.5, most: float = 2.0, schedule: Schedule = ramped_weights, seed: int = 17, by: str = "source", queue_parts: int = 1024) -> DataFrame:
    """Adds size, source_size, target, copies (int), taken (long), position (double), positions (array<double>) and at_word.

    Every document comes floor(target / source size) times. The words still due come from the head of the source's
    queue, a fixed shuffle by a hash of the row: a document is taken once more if the middle of its words lies before
    the due mark. So a source is off by at most half a document, no document passes `most` times its size where
    `most` is whole, and reruns agree. `positions` holds a training time for each copy: pass k over the queue begins
    after k times the source's size, and the words dealt before the copy, over the target, go through the inverted
    schedule; `position` is the first copy's and `at_word` holds the words that all sources together demand up to each
    copy's time; all three are null if the document is not taken. A null source is a source of its own, last in order.
    Null and empty texts have size 0 and are taken 0 words. Repeated rows each have a place
    of their own in the queue, one after the other; which of them is taken is fixed when their numbers are written.
    Columns with the names of the
    added ones are replaced, all others stay whatever their name. No rows give no rows.
    """
    sized = _sized(documents, seed, by)
    return _mixed(sized, written(sized.drop("doc"), "mix-sizes"), share, most, schedule, queue_parts)


def _sized(documents: DataFrame, seed: int, by: str) -> DataFrame:
    """(doc struct of the input's columns, s, size, key): s is the source as a text that is never null."""
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in MADE]
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))
    source = F.coalesce(F.concat(F.lit("s"), F.col(by).cast("string")), F.lit("n"))
    return documents.select(F.struct(*kept).alias("doc"), source.alias("s"), word_count().alias("size"), key.alias("key"))


def _mixed(sized: DataFrame, slim: DataFrame, share: float, most: float, schedule: Schedule, queue_parts: int) -> DataFrame:
    """Plans the sources and queues on `slim` (s, size, key) and decides for the rows of `sized` how often each is taken, and when."""
    spark = sized.sparkSession
    sizes = slim.groupBy(F.when(F.col("s") != "n", F.substring("s", 2, 1 << 30)).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, share, most, schedule)
    plan = spark.createDataFrame(
        [("n" if r["source"] is None else "s" + r["source"], r["source_size"], r["target"], r["w0"], r["w1"]) for r in targets], "s string, source_size long, target double, w0 double, w1 double"
    )
    # one row a distinct (source, key); rows that share it are numbered below
    units = slim.groupBy("s", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    units = units.withColumn("part", F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 65 - queue_parts.bit_length()).cast("int"))
    by_part = units.groupBy("s", "part").agg(F.sum("words").alias("n"))
    ahead = by_part.select("s", "part", (F.sum("n").over(Window.partitionBy("s").orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.sum("words").over(Window.partitionBy("s", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    start = units.withColumn("inside", inside).join(ahead, ["s", "part"]).select("s", "key", "rows", (F.col("ahead") + F.col("inside")).alias("start"))
    single = sized.join(start.where("rows = 1").drop("rows"), ["s", "key"])
    several = _in_turn(sized.join(start.where("rows > 1").drop("rows"), ["s", "key"]))
    joined = single.unionByName(several.select(*single.columns)).join(plan, "s")
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) + F.lit(1e-12))
    due = F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))
    middle = F.col("start") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, whole + F.when(middle < due, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    place = lambda k: _position(F.least(F.lit(1.0), (k * F.col("source_size") + F.col("start")) / F.col("target")))
    once, twice = _joint_demand(targets)
    out = joined.withColumn("copies", copies).withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), place)))
    kept = [F.col(f"doc.`{c}`").alias(c) for c in sized.schema["doc"].dataType.names] if "doc" in sized.columns else []
    return out.select(
        *kept, "size", "source_size", "target", "copies", (F.col("copies").cast("long") * F.col("size")).alias("taken"), F.col("positions")[0].alias("position"), "positions",
        F.transform("positions", lambda t: F.lit(once) * t + F.lit(twice) * t * t).alias("at_word"),
    )


def _in_turn(rows: DataFrame) -> DataFrame:
    """Moves `start` of rows that share a place (s, key) on by the sizes of those before them, in order of a written number.

    A number's upper bits name the task that wrote it: a place's sizes are summed a task, and then inside the task, so
    no task holds more of a place than one wrote.
    """
    numbered = written(rows.withColumn("u", F.monotonically_increasing_id()), "mix-repeats").withColumn("lane", F.shiftright("u", 33))
    lanes = numbered.groupBy("s", "key", "lane").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("s", "key").orderBy("lane")) - F.col("n")
    inside = F.sum("size").over(Window.partitionBy("s", "key", "lane").orderBy("u")) - F.col("size")
    moved = numbered.withColumn("inside", inside).join(lanes.select("s", "key", "lane", ahead.alias("ahead")), ["s", "key", "lane"])
    return moved.withColumn("start", F.col("start") + F.col("ahead") + F.col("inside"))


def _joint_demand(targets: list[dict]) -> tuple[float, float]:
    """(a, b): all sources together demand a t + b t^2 words up to training time t."""
    once = twice = 0.0
    for r in targets:
        total = (r["w0"] + r["w1"]) / 2
        if total > 0:
            once += r["target"] * r["w0"] / total
            twice += r["target"] * (r["w1"] - r["w0"]) / 2 / total
    return once, twice


def curriculum(mixed: DataFrame) -> DataFrame:
    """The training order: every taken document as often as it is taken, range-sorted by the word at which each copy is due.

    Adds copy (int, from 0); `position` and `at_word` (double) are the copy's own.
    """
    columns = [c for c in mixed.columns if c.lower() not in ("position", "positions", "copy", "at_word")]
    pairs = F.arrays_zip(F.col("positions").alias("position"), F.col("at_word").alias("at_word"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    each = mixed.where("copies > 0").select(row, F.posexplode(pairs).alias("copy", "due")).select("row.*", "copy", "due.position", "due.at_word")
    return each.repartitionByRange(shuffle_parts(mixed.sparkSession), "at_word", "doc_id").sortWithinPartitions("at_word", "doc_id", "copy")


def op5_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in training order of their first copy, those not taken last."""
    sized = _sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), 17, "source")
    slim = written(sized.select(F.struct(F.col("doc.doc_id")).alias("doc"), "s", "size", "key"), "mix-sizes")
    mixed = _mixed(slim, slim.drop("doc"), 1.5, 2.0, ramped_weights, 1024)
    due = F.coalesce(F.col("at_word")[0], F.lit(float("inf")))
    rows = written(mixed.select("doc_id", "size", "source_size", "target", "taken", "position", due.alias("at_word")), "mix-taken")
    return rows.repartitionByRange(shuffle_parts(spark), "at_word", "doc_id").sortWithinPartitions("at_word", "doc_id")

"""Prefix trie of conversations by distributed MSD radix partitioning over dictionary-encoded turns.

Turns get dictionary ids. All conversations start in one bucket, the root. A level works on all buckets that are too
large for one task: it finds how far the members of a bucket run together (an unbranched path of nodes), deals them out
by the id of the next turn and so makes the next buckets. A bucket that fits one task is finished there by multikey
quicksort. What a node needs of its subtree is summed on the way back, level by level. A node is known by its depth and
its smallest member, as nodes of one depth share no members.

Levels are as many as branchings lie above each other in buckets that are too large, so a turn, a start or a whole
conversation that very many share costs no depth, and no key ever gathers its rows in one task: joins on keys that hold
over a thousandth of the rows meet a broadcast of these (at most a thousand) keys, long conversations join in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import group_bounds, shuffle_parts, sorted_runs, table, text_or_empty, written

STRETCH = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def split_join(left: DataFrame, right: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """Inner join with a `right` that is unique in `on`; the rows marked `hot`, of which there must be at most about a thousand, are broadcast."""
    few = F.broadcast(right.where(hot))
    cold = left.join(few.select(*on), on, "left_anti").join(right.where(~hot), on)
    return left.join(few, on).unionByName(cold)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, key binary, words): turns in their order, null first; equal turn numbers by the digest of role and text.

    Rows are dealt by ranges of the order and numbered within a part, so a conversation of any length splits over tasks.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    slim = written(slim, "trie-rows")
    order = ["conv_id", F.asc_nulls_first("turn"), "key", "row"]
    dealt = slim.repartitionByRange(shuffle_parts(slim.sparkSession), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "trie-dealt")
    by = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("inside", F.row_number().over(by) - 1)
    return inside.join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("inside")).alias("pos"), "key", "words")


def encoded_turns(placed: DataFrame) -> DataFrame:
    """Turns with `turn_id` (long), one for each distinct role and text, instead of their digest."""
    placed = written(placed, "trie-placed")
    total = placed.count()
    ids = placed.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).withColumn("turn_id", F.monotonically_increasing_id())
    ids = written(ids, "trie-dictionary")
    return split_join(placed, ids, ["key"], F.col("uses") * 1000 > total).select("conv_id", "pos", "turn_id", "words")


def stretches(labels: DataFrame, begin: str, end: str) -> DataFrame:
    """Labels once for each stretch of positions from `begin` to before `end`, so that they meet their turns by (conv_id, stretch)."""
    first, last = F.floor(F.col(begin) / STRETCH), F.floor((F.col(end) - 1) / STRETCH)
    return labels.where(F.col(end) > F.col(begin)).withColumn("stretch", F.explode(F.sequence(first, last)))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members (conv_id, len)) where conversation c begins with the first h original turns of c - c % 20 and
    goes on with its own after its first h; h = crc32 of its decimal id, mod 4.

    The remainder has the sign of c. A base that is not there gives no turns, a shorter one all it has.
    """
    turns = written(turns, "trie-original")
    lens = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    c = F.col("conv_id")
    known = lens.withColumn("base", c - c % 20).withColumn("h", F.crc32(c.cast("string").cast("binary")) % 4)
    info = known.join(lens.select(F.col("conv_id").alias("base"), F.col("own").alias("base_len")), "base", "left")
    info = info.withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0))))
    info = written(info.withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations")
    heads = turns.where("pos < 3").withColumnRenamed("conv_id", "base").join(info.select("conv_id", "base", "h"), "base").where("pos < h")
    own = turns.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).join(stretches(info.select("conv_id", "h", "own", "taken"), "h", "own"), ["conv_id", "stretch"]).where("pos >= h")
    whole = heads.select("conv_id", "pos", "turn_id", "words").unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "words"))
    return written(whole, "trie-turns"), info.select("conv_id", "len")


class _Local:
    """Nodes of buckets that one task holds, in the order of their emission: parents before children."""

    def __init__(self) -> None:
        self.conv, self.depth, self.parent, self.up, self.n, self.children, self.saved, self.ends, self.top = ([] for _ in range(9))

    def node(self, conv: int, depth: int, parent: int | None, up: int, n: int, own: int, ended: list[int], top: bool = False) -> int:
        self.conv.append(conv)
        self.depth.append(depth)
        self.parent.append(parent)
        self.up.append(up)
        self.n.append(n)
        self.children.append(0)
        self.saved.append(own)
        self.ends.append(hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else EMPTY)
        self.top.append(top)
        return len(self.conv) - 1

    def bucket(self, convs: list[int], starts: list[int], lens: list[int], turn: list[int], words: list[int], depth: int, parent: int | None, own: int) -> None:
        """Sort the members (ids ascending, member i's turns from `depth` on at starts[i]) by multikey quicksort and emit their nodes."""

        def emit(group: list[int], d: int, parent: int | None, up: int, own: int, top: bool = False) -> None:
            at = self.node(convs[group[0]], depth + d, parent, up, len(group), own, [convs[m] for m in group if lens[m] == d], top)
            going = [m for m in group if lens[m] > d]
            if going:
                stack.append((going, d, at))

        stack: list[tuple[list[int], int, int]] = []
        emit(list(range(len(convs))), 0, parent, -1, own, True)
        while stack:
            group, d, at = stack.pop()
            if len(group) == 1:
                m = group[0]
                for k in range(d, lens[m]):
                    self.children[at] += 1
                    at = self.node(convs[m], depth + k + 1, self.conv[at], at, 1, 0, [convs[m]] if k + 1 == lens[m] else [])
                continue
            pivot = turn[starts[group[len(group) // 2]] + d]
            less, same, more = [], [], []
            for m in group:
                x = turn[starts[m] + d]
                (same if x == pivot else less if x < pivot else more).append(m)
            for part in (less, more):
                if part:
                    stack.append((part, d, at))
            self.children[at] += 1
            emit(same, d + 1, self.conv[at], at, (len(same) - 1) * words[starts[same[0]] + d])

    def batch(self) -> pa.RecordBatch:
        leaves, saved = [int(not c) for c in self.children], self.saved
        for i in range(len(leaves) - 1, -1, -1):
            if self.up[i] >= 0:
                leaves[self.up[i]] += leaves[i]
                saved[self.up[i]] += saved[i]
        whole = [self.conv, self.depth, self.parent, self.n, self.children, leaves, saved]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in whole), pa.array(self.ends, pa.string()), pa.array(self.top, pa.bool_())], names=[x.split()[0] for x in f"{NODE}, top boolean".split(", ")])


def _finish(rows: DataFrame) -> DataFrame:
    """Nodes of local buckets. Rows: bucket, depth, conv_id, pos, turn_id, words, with a row of pos -1 for each member that
    has the parent as turn_id and what the top node itself saves as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sorted_runs(batches, "bucket"):
            bucket, depth, conv, pos, turn, words = (whole.column(c).to_numpy() for c in ("bucket", "depth", "conv_id", "pos", "turn_id", "words"))
            local, heads = _Local(), np.flatnonzero(pos < 0)
            ends = np.r_[heads[1:], len(pos)]
            turns, counts = turn.tolist(), words.tolist()
            for first, n in zip(*group_bounds(bucket[heads])):
                own, d = heads[first : first + n], int(depth[heads[first]])
                local.bucket(conv[own].tolist(), (own + 1).tolist(), (ends[first : first + n] - own - 1).tolist(), turns, counts, d, turns[own[0]] if d else None, counts[own[0]])
            yield local.batch()

    held = rows.select("bucket", "depth", "conv_id", "pos", "turn_id", "words").repartition("bucket").sortWithinPartitions("bucket", "conv_id", "pos")
    return held.mapInArrow(run, f"{NODE}, top boolean")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(bucket, depth, ends_sha256) of (bucket, depth, conv_id). A digest is one stream, so a node's ids pass one task, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, hashlib.sha256(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), batch.column(2).to_numpy()
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key, text = tuple(keys[a].tolist()), ",".join(map(str, ids[a:b].tolist())).encode()
                if key == now:
                    state.update(b"," + text)
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(text)
            if len(done) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "depth", "ends_sha256"), x)) for x in done])
                done = []
        if now is not None:
            done.append((*now, state.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "depth", "ends_sha256"), x)) for x in done])

    return ends.select("bucket", "depth", "conv_id").repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "conv_id").mapInArrow(run, "bucket long, depth long, ends_sha256 string")


def _earlier(path: DataFrame) -> DataFrame:
    """Adds `earlier`: the sum of `own` over the nodes above on one path; paths of any length, by stretches of depths."""
    cut = path.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    sums = cut.groupBy("bucket", "stretch").agg(F.sum("own").alias("s"))
    offsets = sums.select("bucket", "stretch", (F.sum("s").over(Window.partitionBy("bucket").orderBy("stretch")) - F.col("s")).alias("offset"))
    inside = F.sum("own").over(Window.partitionBy("bucket", "stretch").orderBy("depth")) - F.col("own")
    return cut.withColumn("inside", inside).join(offsets, ["bucket", "stretch"]).withColumn("earlier", F.col("offset") + F.col("inside"))


def prefix_trie(turns: DataFrame, members: DataFrame, local_rows: int = 4096) -> DataFrame:
    """One row a node (columns of NODE) for `turns` (conv_id, pos, turn_id, words) and `members` (conv_id, len), both written tables.

    Every member has the turns 0 to len - 1; members of length 0 belong to the root only. Buckets of at most
    `local_rows` turns and members are finished in one task each. A single conversation is never gathered: its own
    stretch of nodes, however long, comes straight from its turns. No members: no rows.
    """
    spark = turns.sparkSession
    start = members.agg(F.count(F.lit(1)).alias("m"), F.min("conv_id").alias("c"), F.sum("len").alias("rows")).first()
    if not start["m"]:
        return spark.createDataFrame([], NODE)
    total = start["m"]
    turns = turns.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    kind = lambda m, rows: F.when(rows + m <= local_rows, "local").when(m == 1, "single").otherwise("large")
    first = "large" if start["rows"] + total > local_rows and total > 1 else "single" if start["rows"] + total > local_rows else "local"
    labels = members.select("conv_id", "len", F.lit(start["c"]).alias("bucket"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(total).alias("m"), F.lit(0).cast("long").alias("own"), F.lit(first).alias("kind"))
    levels, finished = [], [labels]
    while not labels.where("kind = 'large'").isEmpty():
        live = labels.where("kind = 'large'")
        entries = live.groupBy("bucket").agg(*[F.first(c).alias(c) for c in ("depth", "parent", "m", "own")])
        met = turns.join(stretches(live, "depth", "len").select("conv_id", "stretch", "bucket", "depth", "m"), ["conv_id", "stretch"]).where("pos >= depth")
        spots = met.groupBy("bucket", "pos").agg((F.min("turn_id") == F.max("turn_id")).alias("same"), F.count(F.lit(1)).alias("n"), F.max("m").alias("m"), F.max("words").alias("words"))
        spots = written(spots.withColumn("same", F.col("same") & (F.col("n") == F.col("m"))), "trie-spots")
        found = spots.groupBy("bucket").agg(F.min(F.when(~F.col("same"), F.col("pos"))).alias("fork"), (F.max("pos") + 1).alias("longest"))
        plan = written(entries.join(found, "bucket", "left").withColumn("stop", F.coalesce("fork", "longest", "depth")), "trie-plan")
        n_spots = spots.count()
        path = split_join(spots.select("bucket", "pos", "words"), plan.where("stop > depth").select("bucket", "depth", "m", "stop", "longest"), ["bucket"], (F.col("longest") - F.col("depth")) * 1000 > n_spots)
        path = path.where("pos < stop").select("bucket", (F.col("pos") + 1).alias("depth"), ((F.col("m") - 1) * F.col("words")).alias("own"))
        at = split_join(live.select("conv_id", "len", "bucket"), plan.select("bucket", "stop", "m"), ["bucket"], F.col("m") * 1000 > total).drop("m")
        at = written(at, "trie-members")
        ends = at.where("len = stop").select("bucket", F.col("stop").alias("depth"), "conv_id")
        dealt = written(at.where("len > stop").join(turns.select("conv_id", F.col("pos").alias("stop"), "turn_id", "words"), ["conv_id", "stop"]), "trie-digits")
        made = dealt.groupBy("bucket", "turn_id").agg(F.count(F.lit(1)).alias("m"), F.min("conv_id").alias("child"), F.sum(F.col("len") - F.col("stop") - 1).alias("rows"), F.max("words").alias("words"))
        made = made.select("bucket", "turn_id", "child", "m", ((F.col("m") - 1) * F.col("words")).alias("own"), kind(F.col("m"), F.col("rows")).alias("kind"))
        below = split_join(dealt.select("conv_id", "len", "stop", "bucket", "turn_id"), made, ["bucket", "turn_id"], F.col("m") * 1000 > total)
        below = below.select("conv_id", "len", F.col("child").alias("bucket"), (F.col("stop") + 1).alias("depth"), F.col("bucket").alias("parent"), "m", "own", "kind")
        labels = written(below, "trie-labels")
        finished.append(labels)
        levels.append((plan, written(path, "trie-path"), ends))

    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    local, single = done.where("kind = 'local'"), done.where("kind = 'single'")
    heads = local.select("bucket", "depth", "conv_id", F.lit(-1).cast("long").alias("pos"), F.col("parent").alias("turn_id"), F.col("own").alias("words"))
    heads = heads.withColumn("turn_id", F.coalesce("turn_id", F.lit(-1)))
    rows = turns.join(stretches(local, "depth", "len").select("conv_id", "stretch", "bucket", "depth"), ["conv_id", "stretch"]).where("pos >= depth")
    nodes = written(_finish(rows.select(*heads.columns).unionByName(heads)), "trie-local")

    def alone(depth: Column, parent: Column) -> list[Column]:
        last = F.col("len") == depth
        ended = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY)
        return [F.col("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ended.alias("ends_sha256")]

    tops = single.select(*alone(F.col("depth"), F.col("parent")))
    tails = turns.join(stretches(single, "depth", "len").select("conv_id", "stretch", "depth", "len"), ["conv_id", "stretch"]).where("pos >= depth").select(*alone(F.col("pos") + 1, F.col("conv_id")))
    out = nodes.drop("top").unionByName(tops).unionByName(tails)
    if not levels:
        return out
    below = nodes.where("top").drop("top").unionByName(tops).groupBy(F.col("parent_conv_id").alias("bucket"), (F.col("depth") - 1).alias("stop")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    below, ended, above = written(below, "trie-tops"), levels[0][2], None
    for _, _, more in levels[1:]:
        ended = ended.unionByName(more)
    digests = written(_end_digests(ended), "trie-ends")
    for plan, path, _ in reversed(levels):
        sums = below if above is None else below.unionByName(above.groupBy(F.col("parent").alias("bucket"), (F.col("depth") - 1).alias("stop")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        sums = sums.groupBy("bucket", "stop").agg(*[F.sum(c).alias(c) for c in ("n", "leaves", "saved")])
        along = path.groupBy("bucket").agg(F.sum("own").alias("along"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        whole = plan.join(sums, ["bucket", "stop"], "left").join(along, "bucket", "left").join(digests.withColumnRenamed("depth", "stop"), ["bucket", "stop"], "left")
        whole = whole.select(
            "bucket", "depth", "stop", "parent", "m", F.coalesce("longest", "depth").alias("longest"), zero("n").alias("n"), F.coalesce("leaves", F.lit(1)).alias("leaves"),
            (F.col("own") + zero("along") + zero("saved")).alias("saved"), F.col("own").alias("entry_own"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends"),
        )
        above = written(whole, "trie-totals")
        at_stop = lambda then, other: F.when(F.col("at") == F.col("stop"), then).otherwise(other)

        def rows_of(saved: Column, parent: str) -> list[Column]:
            return [F.col("bucket").alias("conv_id"), F.col("at").alias("depth"), F.col(parent).alias("parent_conv_id"), F.col("m").alias("n_convs"), at_stop(F.col("n"), F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), at_stop(F.col("ends"), F.lit(EMPTY)).alias("ends_sha256")]

        own = above.withColumn("at", F.col("depth")).select(*rows_of(F.col("saved"), "parent"))
        steps = _earlier(path).select("bucket", F.col("depth").alias("at"), "earlier")
        inner = split_join(steps, above, ["bucket"], (F.col("longest") - F.col("depth")) * 1000 > path.count())
        out = out.unionByName(own).unionByName(inner.select(*rows_of(F.col("saved") - F.col("entry_own") - F.col("earlier"), "bucket")))
    return out


def conversation_trie(conversations: DataFrame, local_rows: int = 4096) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text).

    Turns stand in order of `turn`, null first, and of a digest of role and text where it is equal; repeated rows are
    turns of their own. Null role or text is empty. Rows without conv_id belong to no conversation and are left out; an
    empty table gives no rows; other columns are not read. Turns are told apart by the SHA-256 digest of role and text.
    """
    turns, members = rebuilt(encoded_turns(placed_turns(conversations)))
    return prefix_trie(turns, members, local_rows)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))

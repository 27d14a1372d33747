"""Balanced ridge classifiers, one for each held-out run, with many label vectors at once.

The products of all rows are summed once by class. A fold takes its held-out run's own products away from these sums, so
no fold reads another run again, and solves one Cholesky factor for all label vectors. The totals that go to the tasks
have (classes x features^2) numbers for the factor and (classes^2 x label vectors x features) for a batch of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.linear import finite_rows, matrix, pieces, summed, width_of
from strandline.sources.working import parts_of, written


def _own(x: np.ndarray, y: np.ndarray, labels: np.ndarray, k: int, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of (1, x) by observed class, and sums of (1, x) by observed class, label vector and its class; classes as places."""
    z = np.column_stack([np.ones(len(x)), x - shift])
    grams = np.stack([z[y == c].T @ z[y == c] for c in range(k)])
    n, b = labels.shape
    sums = np.zeros((k, b, k, z.shape[1]))
    for c in range(k):
        own, lab = z[y == c], labels[y == c]
        for q in range(k):
            sums[c, :, q] = (lab == q).T.astype(float) @ own
    return grams, sums


def _scores(grams: np.ndarray, sums: np.ndarray, x: np.ndarray, shift: np.ndarray, alpha: float) -> np.ndarray | None:
    """(rows, label vectors, columns) ridge scores from the training sums; None where a class has no training row.

    Rows weigh n / (classes * rows of the class) by their observed class for all label vectors. Targets are +1 and -1; two
    classes have one column, for the second.
    """
    counts = grams[:, 0, 0]
    k, b = sums.shape[0], sums.shape[1]
    if (counts < 0.5).any():
        return None
    weight = counts.sum() / (k * counts)
    a = np.einsum("c,cij->ij", weight, grams)
    s = np.einsum("c,cbqi->bqi", weight, sums)
    total, centre = a[0, 0], a[0, 1:] / a[0, 0]
    target = 2 * s - a[0][None, None]  # sums of weight * (1, x) * (+1 or -1)
    target = target[:, 1:] if k == 2 else target
    columns = target.shape[1]
    offset = target[:, :, 0] / total
    rhs = target[:, :, 1:] - target[:, :, :1] * centre
    factor = np.linalg.cholesky(a[1:, 1:] - np.outer(centre, centre) * total + alpha * np.eye(len(centre)))
    flat = rhs.reshape(b * columns, -1).T
    coef = np.linalg.solve(factor.T, np.linalg.solve(factor, flat))
    return ((x - shift - centre) @ coef + offset.ravel()).reshape(len(x), b, columns)


def leave_one_run_out(rows: DataFrame, labels: list[str], alpha: float = 1.0, features: str = "features") -> DataFrame:
    """(run, tr, target, label, predicted, scores): every row scored by the classifier trained on all other runs.

    `labels` are columns of state numbers: the observed one first, then null label vectors, which keep the observed
    one's weights; target is the place in the list. scores holds a number a class in the order of the classes (two classes:
    one number, for the second), predicted the class of the largest, ties to the smaller. Classes are those that the
    observed labels have. Rows with a null label or features that are not finite are left out; runs whose training rows
    lack a class are not scored, as there is no classifier; a null label outside the classes is an error.
    """
    first = labels[0]
    whole = finite_rows(rows.where(" and ".join(f"`{c}` is not null" for c in ["run", "tr", *labels])), features)
    whole = whole.select(F.col("run").cast("long").alias("run"), F.col("tr").cast("int").alias("tr"), F.col(features).cast("array<double>").alias("x"), F.array(*[F.col(c).cast("int") for c in labels]).alias("y"))
    whole = written(whole, "ridge-rows")
    classes = np.array(sorted(r["c"] for r in whole.select(F.col("y")[0].alias("c")).distinct().collect()), np.int64)  # a row a state
    schema = "run long, tr int, target int, label int, predicted int, scores array<double>"
    if len(classes) < 2:
        return rows.sparkSession.createDataFrame([], schema)
    strange = whole.where(F.exists("y", lambda c: ~c.isin([int(c) for c in classes])))
    if not strange.isEmpty():
        raise ValueError(f"labels of {first} lack a class that another label vector has")
    k, b, d = len(classes), len(labels), width_of(whole, "x")
    shift = np.array(whole.select("x").first()[0])
    shapes = (k, d + 1, d + 1), (k, b, k, d + 1)
    cut = int(np.prod(shapes[0]))

    def products(piece: pa.RecordBatch) -> np.ndarray:
        y = np.searchsorted(classes, matrix(piece.column(1)).astype(np.int64))
        return np.concatenate([m.ravel() for m in _own(matrix(piece.column(0)), y[:, 0], y, k, shift)])

    total = summed(whole, ["x", "y"], cut + int(np.prod(shapes[1])), products)
    grams, sums = total[:cut].reshape(shapes[0]), total[cut:].reshape(shapes[1])

    def fold(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, y = matrix(table.column("x")), np.searchsorted(classes, matrix(table.column("y")).astype(np.int64))
        own_grams, own_sums = _own(x, y[:, 0], y, k, shift)
        scores = _scores(grams - own_grams, sums - own_sums, x, shift, alpha)
        n = 0 if scores is None else len(x)
        best = np.zeros((0, b), np.int64) if not n else scores.argmax(axis=2) if k > 2 else (scores[:, :, 0] > 0).astype(np.int64)
        flat = np.zeros((0, 1)) if not n else scores.reshape(n * b, -1)
        row = np.repeat(np.arange(n), b)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
        return pa.table(
            {
                "run": table.column("run").take(pa.array(row)), "tr": table.column("tr").take(pa.array(row)), "target": pa.array(np.tile(np.arange(b, dtype=np.int32), n)),
                "label": pa.array(classes[y[:n].ravel()].astype(np.int32)), "predicted": pa.array(classes[best.ravel()].astype(np.int32)), "scores": lists,
            }
        )

    return whole.groupBy("run").applyInArrow(fold, schema)


def decoding_metrics(scored: DataFrame) -> DataFrame:
    """(target, n, balanced_accuracy, weighted_f1, kappa) of `leave_one_run_out`'s pooled predictions; counts only.

    balanced_accuracy averages the recall over classes that the labels have; a class never predicted has F1 0.
    """
    pairs = scored.groupBy("target", "label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    is_ = pairs.groupBy("target", F.col("label").alias("c")).agg(F.sum("n").alias("true"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy("target", F.col("predicted").alias("c")).agg(F.sum("n").alias("said"))
    both = is_.join(said, ["target", "c"], "full").fillna(0, ["true", "hit", "said"])
    out = both.groupBy("target").agg(
        F.sum("true").alias("n"), F.avg(F.when(F.col("true") > 0, F.col("hit") / F.col("true"))).alias("balanced_accuracy"), F.sum("hit").alias("_h"),
        F.sum(F.col("true") * 2 * F.col("hit") / (F.col("true") + F.col("said"))).alias("_f"), F.sum(F.col("true").cast("double") * F.col("said")).alias("_e"),
    )
    chance = F.col("_e") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(chance < 1, (F.col("_h") / F.col("n") - chance) / (1 - chance))
    return out.select("target", "n", "balanced_accuracy", (F.col("_f") / F.col("n")).alias("weighted_f1"), kappa.alias("kappa"))


def ranked_areas(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """(by, n_pos, n_neg, auc) by Mann and Whitney over groups of any size; null where a side has no rows.

    Scores are counted by value and dealt by ranges; a part counts within itself and starts from the counts of the parts
    before it, so no group is sorted in one task.
    """
    spark = rows.sparkSession
    y = F.col(positive).cast("long")
    values = written(rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*by, score, y.alias("y")), "auc-values")
    n_parts = parts_of(spark, values.count())
    dealt = values.repartitionByRange(n_parts, *by, score).withColumn("part", F.spark_partition_id())  # equal scores share a part
    dealt = written(dealt, "auc-ranges").repartition(n_parts, *by, "part")
    dealt = written(dealt.groupBy(*by, "part", score).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")), "auc-parts")
    parts = dealt.groupBy(*by, "part").agg(F.sum("q").alias("s"))
    before = parts.select(*by, "part", (F.sum("s").over(Window.partitionBy(*by).orderBy("part")) - F.col("s")).alias("before"))
    inside = F.sum("q").over(Window.partitionBy(*by, "part").orderBy(score)) - F.col("q")
    below = dealt.repartition(n_parts, *by, "part").withColumn("inside", inside).join(before, [*by, "part"])
    won = F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("q") / 2))
    out = below.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), won.alias("_w"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def state_areas(scored: DataFrame, classes: list[int]) -> DataFrame:
    """(target, state, n_pos, n_neg, auc): how well each state's score tells its rows from all others, pooled over the folds."""
    states = F.array(*map(F.lit, classes))
    one = F.col("scores")[0]
    scores = F.when(F.size("scores") == 1, F.array(-one, one)).otherwise(F.col("scores"))
    long = scored.select("target", "label", F.explode(F.arrays_zip(states.alias("state"), scores.alias("score"))).alias("z"))
    return ranked_areas(long.select("target", F.col("z.state").alias("state"), F.col("z.score").alias("score"), (F.col("label") == F.col("z.state")).alias("y")), "score", "y", ["target", "state"])


def shifted_labels(rows: DataFrame, n_draws: int, seed: int, label: str = "label") -> DataFrame:
    """Adds null_1 .. null_n: the run's labels shifted round by a hashed number of TRs, at least one in a run of two or more."""
    from strandline.functions.draws import uniform

    order, run = Window.partitionBy("run").orderBy("tr"), Window.partitionBy("run")
    held = rows.withColumn("_k", F.row_number().over(order) - 1).withColumn("_all", F.collect_list(label).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_n", F.count(F.lit(1)).over(run))
    for draw in range(1, n_draws + 1):
        by = F.when(F.col("_n") > 1, 1 + F.floor(uniform(seed, F.lit(draw), "run") * (F.col("_n") - 1))).otherwise(0)
        held = held.withColumn(f"null_{draw}", F.col("_all")[F.pmod(F.col("_k") - by, F.col("_n")).cast("int")])
    return held.drop("_k", "_all", "_n")


def in_both(train: DataFrame, test: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Both tables' rows of the states that either of them has."""
    shared = train.select(label).distinct().intersect(test.select(label).distinct())
    return train.join(shared, label, "left_semi"), test.join(shared, label, "left_semi")


def transfer(train: DataFrame, test: DataFrame, labels: list[str], subset: str, alpha: float = 1.0, features: str = "features") -> DataFrame:
    """(target, subset, label, predicted, n): counts of the test rows under classifiers fitted to all train rows.

    Each label vector of `train` (the observed one first) has a classifier of its own, whose rows weigh n / (classes * rows of
    the class) by that vector; the test rows keep their label, in the column labels[0]. Classes are those of the observed train
    labels. Rows with a null label, features that are not finite or a label outside the classes are left out, and so is a label
    vector that lacks a class. `subset` is a text column of `test`; null is a subset too. Fewer than two classes or no test row
    give no rows.

    The sums over `train` are (label vectors x features^2 / 2) numbers, which a task sends once and the driver solves; the test rows
    are only counted, so no table of scores is made.
    """
    first = labels[0]
    clean = lambda rows, names: finite_rows(rows.where(" and ".join(f"`{c}` is not null" for c in names)), features).withColumn("x", F.col(features).cast("array<double>"))
    whole = written(clean(train, labels).select("x", F.array(*[F.col(c).cast("int") for c in labels]).alias("y")), "transfer-rows")
    schema = "target int, subset string, label int, predicted int, n long"
    classes = np.array(sorted(r["c"] for r in whole.select(F.col("y")[0].alias("c")).distinct().collect()), np.int64)  # a row a state
    if len(classes) < 2:
        return train.sparkSession.createDataFrame([], schema)
    k, b, d = len(classes), len(labels), width_of(whole, "x")
    whole = whole.where(F.forall("y", lambda c: c.isin([int(c) for c in classes])))
    shift = np.array(whole.select("x").first()[0])
    counts = np.zeros((b, k))
    for r in whole.select(F.posexplode("y").alias("t", "c")).groupBy("t", "c").count().collect():  # a row a label vector and state
        counts[r["t"], np.searchsorted(classes, r["c"])] = r["count"]
    fitted = np.flatnonzero((counts > 0).all(axis=1))
    weights = counts[fitted].sum(axis=1, keepdims=True) / (k * counts[fitted])
    upper, cut = np.triu_indices(d + 1), len(fitted) * (d + 1) * (d + 2) // 2

    def products(piece: pa.RecordBatch) -> np.ndarray:
        x, y = matrix(piece.column(0)), np.searchsorted(classes, matrix(piece.column(1)).astype(np.int64))[:, fitted]
        z = np.column_stack([np.ones(len(x)), x - shift])
        grams = [((z * w[own][:, None]).T @ z)[upper] for w, own in zip(weights, y.T)]
        sums = np.stack([((y == q).T.astype(float) @ z) * weights[:, q : q + 1] for q in range(k)], axis=1)
        return np.concatenate([*grams, sums.ravel()])

    total = summed(whole, ["x", "y"], cut + len(fitted) * k * (d + 1), products)
    halves, sums = total[:cut].reshape(len(fitted), -1), total[cut:].reshape(len(fitted), k, d + 1)
    columns = 1 if k == 2 else k
    coef, offset = np.zeros((len(fitted), d, columns)), np.zeros((len(fitted), columns))
    for t in range(len(fitted)):
        a = np.zeros((d + 1, d + 1))
        a[upper] = halves[t]
        a = a + np.triu(a, 1).T
        target = (2 * sums[t] - a[0])[1 if k == 2 else 0 :]  # sums of weight * (1, x) * (+1 or -1)
        centre = a[0, 1:] / a[0, 0]
        coef[t] = np.linalg.solve(a[1:, 1:] - np.outer(centre, centre) * a[0, 0] + alpha * np.eye(d), (target[:, 1:] - target[:, :1] * centre).T)
        offset[t] = target[:, 0] / a[0, 0] - centre @ coef[t]
    flat = coef.transpose(1, 0, 2).reshape(d, -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                y = np.searchsorted(classes, piece.column(1).to_numpy(zero_copy_only=False))
                scores = ((matrix(piece.column(0)) - shift) @ flat).reshape(len(y), len(fitted), columns) + offset
                best = scores.argmax(axis=2) if k > 2 else (scores[:, :, 0] > 0).astype(np.int64)
                group = piece.column(2).dictionary_encode()
                names = group.dictionary.to_pylist() + [None]
                at = group.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
                code = ((np.arange(len(fitted)) * len(names) + at[:, None]) * k + y[:, None]) * k + best
                code, n = np.unique(code, return_counts=True)
                place = code // (k * k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fitted[place // len(names)].astype(np.int32)), pa.array([names[i] for i in place % len(names)], pa.string()), pa.array(classes[code // k % k].astype(np.int32)), pa.array(classes[code % k].astype(np.int32)), pa.array(n)],
                    names=["target", "subset", "label", "predicted", "n"],
                )

    held = clean(test, [first]).where(F.col(first).isin([int(c) for c in classes])).select("x", F.col(first).cast("int").alias("y"), F.col(subset).cast("string").alias("g"))
    return held.mapInArrow(count, schema).groupBy("target", "subset", "label", "predicted").agg(F.sum("n").alias("n"))


def transfer_test(counts: DataFrame, n_classes: int) -> DataFrame:
    """(subset, n, n_present, balanced_accuracy, effect, null_mean, n_draws, p) of `transfer`'s counts, for each subset and for all
    rows as subset 'all'.

    The recall is averaged over the classes that the subset's labels have; effect is its share of the way from chance,
    1 / n_classes, to 1. p counts the data among the draws. Subsets with fewer than two classes are left out.
    """
    pooled = counts.withColumn("subset", F.lit("all")).unionByName(counts)
    recall = pooled.groupBy("target", "subset", "label").agg((F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"), F.sum("n").alias("n"))
    score = recall.groupBy("target", "subset").agg(F.avg("r").alias("a"), F.count(F.lit(1)).alias("n_present"), F.sum("n").alias("n")).where("n_present > 1")
    seen = score.where("target = 0").select("subset", "n", "n_present", F.col("a").alias("balanced_accuracy"))
    null = score.where("target > 0").select(F.col("subset").alias("s"), "a")
    met = seen.join(null, F.col("subset").eqNullSafe(F.col("s")), "left").groupBy("subset", "n", "n_present", "balanced_accuracy").agg(
        F.avg("a").alias("null_mean"), F.count("a").alias("n_draws"), F.sum(F.coalesce((F.col("a") >= F.col("balanced_accuracy") - 1e-12).cast("long"), F.lit(0))).alias("_b")
    )
    effect = (F.col("balanced_accuracy") - 1 / n_classes) / (1 - 1 / n_classes)
    return met.select("subset", "n", "n_present", "balanced_accuracy", effect.alias("effect"), "null_mean", "n_draws", ((F.col("_b") + 1) / (F.col("n_draws") + 1)).alias("p"))

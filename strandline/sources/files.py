"""Scans of run files: session tables, acquisition times, confounds, label tables, run lists, dense arrays, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION = r"(ses-[A-Za-z0-9]+)"
FUNCTIONAL = r"^func/sub-[^/]+_task-([A-Za-z0-9]+)_.*bold\.nii\.gz$"
TR_SECONDS = 1.49


def _path() -> Column:
    return F.col("_metadata.file_path")


def _delimited(spark: SparkSession, path, sep: str) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def _required(rows: DataFrame, columns: list[str]) -> None:
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def session_scans(spark: SparkSession, path, pattern: str = FUNCTIONAL) -> DataFrame:
    """(run_id, session_id, rel_acq_time, filename) of the functional rows of session tables, in order of session, time
    and run. A functional row without a time raises; a file of another kind is left out."""
    rows = _delimited(spark, path, "\t")
    _required(rows, ["filename", "rel_acq_time"])
    name, time = F.trim("filename"), F.trim("rel_acq_time")
    kept = rows.select(name.alias("filename"), time.alias("rel_acq_time"), F.regexp_extract(_path(), SESSION, 1).alias("session_id")).where(name.rlike(pattern))
    at = F.when(F.coalesce(F.col("rel_acq_time"), F.lit("")) == "", F.raise_error(F.concat(F.lit("no rel_acq_time: "), F.col("filename")))).otherwise(F.col("rel_acq_time"))
    return kept.select(F.regexp_extract("filename", pattern, 1).alias("run_id"), "session_id", at.cast("double").alias("rel_acq_time"), "filename").orderBy("session_id", "rel_acq_time", "run_id")


def one_session(candidates: DataFrame, pins: DataFrame, keys: tuple[str, ...] = ("subject", "run_id")) -> DataFrame:
    """The one candidate of each run, which has session_id: its only one, or the one of the pinned session.

    `pins` has the keys and pinned. Several candidates without a pin raise, and so does a pin that does not match
    exactly one candidate.
    """
    group = Window.partitionBy(*keys)
    joined = candidates.join(pins, list(keys), "left").withColumn("_n", F.count(F.lit(1)).over(group))
    match = F.col("session_id").eqNullSafe(F.col("pinned"))
    joined = joined.withColumn("_m", F.sum(match.cast("int")).over(group))
    name = F.concat_ws(" ", *keys)
    wrong = (
        F.when(F.col("pinned").isNull() & (F.col("_n") > 1), F.raise_error(F.concat(F.lit("several copies and none is chosen: "), name)))
        .when(F.col("pinned").isNotNull() & (F.col("_m") != 1), F.raise_error(F.concat(F.lit("not exactly one copy of the chosen session: "), name)))
        .otherwise(F.lit(True))
    )
    return joined.where(wrong & (F.col("pinned").isNull() | match)).drop("pinned", "_n", "_m")


def acquisition_times(spark: SparkSession, path, pins: DataFrame, subject: str) -> DataFrame:
    """(run_id, session_id, acq_time) of a subject's times; the session comes from its column or from the file name."""
    rows = _delimited(spark, path, ",")
    _required(rows, ["run_id", "rel_acq_time"])
    from_name = F.nullif(F.regexp_extract("filename", SESSION, 1), F.lit("")) if "filename" in rows.columns else F.lit(None).cast("string")
    session = F.coalesce(F.nullif(F.trim("session_id"), F.lit("")), from_name) if "session_id" in rows.columns else from_name
    plain = rows.select(F.lit(subject).alias("subject"), "run_id", session.alias("session_id"), F.col("rel_acq_time").cast("double").alias("acq_time"))
    return one_session(plain, pins).select("run_id", "session_id", "acq_time")


def median_displacement(spark: SparkSession, path, run_pattern: str = r"task-([A-Za-z0-9]+)_") -> DataFrame:
    """(run_id, session_id, median_fd): median framewise displacement of each confounds file, without its gaps; one column is read."""
    rows = _delimited(spark, path, "\t")
    _required(rows, ["framewise_displacement"])
    fd = F.expr("try_cast(framewise_displacement as double)")
    each = rows.select(F.regexp_extract(_path(), run_pattern, 1).alias("run_id"), F.regexp_extract(_path(), SESSION, 1).alias("session_id"), F.when(~F.isnan(fd), fd).alias("fd"))
    return each.groupBy("run_id", "session_id").agg(F.median("fd").alias("median_fd"))


def confounds(spark: SparkSession, path, columns: list[str], prefix: str | None = "cosine", run_pattern: str = r"task-([A-Za-z0-9]+)_") -> DataFrame:
    """(run_id, tr, confounds...): the columns and all that begin with `prefix`, demeaned in their run, gaps then 0.

    Rows keep the order of their file.
    """
    rows = _delimited(spark, path, "\t")
    _required(rows, columns)
    wanted = columns + [c for c in rows.columns if prefix and c.startswith(prefix) and c not in columns]
    value = lambda c: F.expr(f"try_cast(`{c}` as double)")
    each = rows.select(_path().alias("path"), F.monotonically_increasing_id().alias("at"), *[F.when(~F.isnan(value(c)), value(c)).alias(c) for c in wanted])
    run = Window.partitionBy("path")
    tr = (F.row_number().over(run.orderBy("at")) - 1).alias("tr")
    return each.select(F.regexp_extract("path", run_pattern, 1).alias("run_id"), tr, *[F.coalesce(F.col(c) - F.avg(c).over(run), F.lit(0.0)).alias(c) for c in wanted])


def run_list(spark: SparkSession, path) -> list[str]:
    """The run ids of a list file, one a line; an empty list raises. A list is a few names, so it comes to the driver."""
    ids = [r["id"] for r in spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").collect()]
    if not ids:
        raise ValueError(f"no run ids in {path}")
    return ids


def paired_labels(spark: SparkSession, path) -> DataFrame:
    """(parcel, label) of label files whose lines alternate between a name and `id r g b a`; a name without a line after it is left out."""
    lines = spark.read.text(path).select("value", _path().alias("path"), F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("path").orderBy("at")
    pairs = lines.withColumn("k", F.row_number().over(order)).withColumn("after", F.lead("value").over(order)).where("k % 2 = 1 and after is not null and trim(after) <> ''")
    return pairs.select(F.split(F.trim("after"), r"\s+")[0].cast("int").alias("parcel"), F.trim("value").alias("label"))


def atlas_labels(spark: SparkSession, path, n_parcels: int | None = None, subcortical: int = 56) -> DataFrame:
    """(parcel, label) of an atlas table: the 17-network label, or where `n_parcels` is given the plain label for its last
    `subcortical` parcels; the plain label where there is no other."""
    rows = _delimited(spark, path, "\t")
    if "label" not in rows.columns and "label_17network" not in rows.columns:
        raise ValueError("neither label nor label_17network")
    index = F.col("index").cast("int")
    label = F.col("label_17network") if "label_17network" in rows.columns else F.col("label")
    if n_parcels is not None:
        label = F.when(index > n_parcels - subcortical, F.col("label")).otherwise(label)
    return rows.select(index.alias("parcel"), label.alias("label"))


def dense_runs(rows: DataFrame, background_widths: tuple[int, ...] = (157, 457, 1057), most: float = 0.001) -> DataFrame:
    """(run, tr, features): arrays without their background column where the width has one, non-finite values as 0.

    A run in which a share of `most` or more is not finite raises.
    """
    kept = F.when(F.size("features").isin(*background_widths), F.slice("features", 2, F.size("features") - 1)).otherwise(F.col("features"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    cut = rows.withColumn("features", kept).withColumn("_bad", F.size(F.filter("features", bad)))
    run = Window.partitionBy("run")
    share = F.sum("_bad").over(run) / F.sum(F.size("features")).over(run)
    checked = cut.withColumn("_share", share)
    ok = F.when(F.col("_share") >= most, F.raise_error(F.concat(F.lit("too many values are not finite: "), F.col("run").cast("string")))).otherwise(F.lit(True))
    return checked.where(ok).select("run", "tr", F.transform("features", lambda x: F.when(bad(x), 0.0).otherwise(x.cast("double"))).alias("features"))


def transcript(words: DataFrame, lengths: DataFrame, seconds: float = TR_SECONDS, shift: float = 0.0) -> DataFrame:
    """(run, tr, text, so_far): the words (run, onset, word) of each TR of (run, n_trs) in order, and all words up to it.

    A word's TR is its shifted onset over the TR's length, cut to a whole number; words outside the run are left out.
    """
    spine = lengths.select("run", F.explode(F.sequence(F.lit(0), F.col("n_trs").cast("int") - 1)).alias("tr"))
    placed = words.select("run", ((F.col("onset") + shift) / seconds).cast("int").alias("tr"), "onset", "word")
    said = placed.groupBy("run", "tr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("onset", "word"))), lambda w: w["word"]), " ").alias("text"))
    each = spine.join(said, ["run", "tr"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    before = Window.partitionBy("run").orderBy("tr").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("so_far", F.array_join(F.filter(F.collect_list("text").over(before), lambda t: t != ""), " "))

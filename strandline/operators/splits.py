"""Splits, folds and shift nulls by hashed draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.draws import draw_hex, uniform


def stratified_split(episodes: DataFrame, seed: int = 42, test: float = 0.15, valid: float = 0.15, least: int = 2) -> DataFrame:
    """(season, episode, role): episodes of a season in hashed order; parts of an episode stay together."""
    order = Window.partitionBy("season").orderBy(draw_hex(seed, "season", "episode"), "episode")
    n = F.count(F.lit(1)).over(Window.partitionBy("season"))
    k = F.row_number().over(order)
    sized = episodes.select("season", "episode").distinct().withColumn("k", k).withColumn("n", n)
    size = lambda share: F.greatest(F.lit(least), F.bround(F.col("n") * share).cast("int"))
    role = F.when(F.col("k") <= size(test), "test").when(F.col("k") <= size(test) + size(valid), "valid").otherwise("train")
    return sized.select("season", "episode", role.alias("role"))


def leave_one_season_out(episodes: DataFrame, seasons: int = 6, seed: int = 42, valid: float = 0.2) -> DataFrame:
    """(held_out, season, episode, role): one fold a season; a fifth of each other season validates."""
    base = episodes.select("season", "episode").distinct().withColumn("held_out", F.explode(F.sequence(F.lit(1), F.lit(seasons))))
    k = F.row_number().over(Window.partitionBy("held_out", "season").orderBy(draw_hex(seed, "held_out", "season", "episode"), "episode"))
    n = F.count(F.lit(1)).over(Window.partitionBy("held_out", "season"))
    marked = base.withColumn("k", k).withColumn("n", n)
    role = F.when(F.col("season") == F.col("held_out"), "test").when(F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("n") * valid).cast("int")), "valid").otherwise("train")
    return marked.select("held_out", "season", "episode", role.alias("role"))


def split_half(episodes: DataFrame) -> DataFrame:
    """(season, episode, half): episodes of a season alternate between the halves."""
    order = Window.partitionBy("season").orderBy("episode")
    return episodes.select("season", "episode").distinct().withColumn("half", ((F.row_number().over(order) - 1) % 2).cast("int"))


def circular_shift(states: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(draw, run, tr, state): each run turned by a hashed number of places from 1 to its length - 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy("run"))
    drawn = states.withColumn("n", n).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    shift = (1 + F.floor(uniform(seed, "draw", "run") * (F.col("n") - 1))).cast("int")
    return drawn.select("draw", "run", F.pmod(F.col("tr") + shift, F.col("n")).cast("int").alias("tr"), "state")


def leave_one_out_folds(rows: DataFrame, unit: str = "run") -> DataFrame:
    """Adds fold (from 0) by the unit's order; the units' distinct list is numbered, not the rows."""
    folds = rows.select(unit).distinct().withColumn("fold", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(unit)) - 1).cast("int"))
    return rows.join(folds, unit)


def split_half_validation(episodes: DataFrame, seed: int = 42, valid: float = 0.2) -> DataFrame:
    """(half, season, episode, role): in each half one episode of a season at most validates, a fifth of it rounded."""
    group = Window.partitionBy("half", "season")
    k = F.row_number().over(group.orderBy(draw_hex(seed, "half", "season", "episode"), "episode"))
    marked = split_half(episodes).withColumn("k", k).withColumn("n", F.count(F.lit(1)).over(group))
    take = F.least(F.lit(1), F.bround(F.col("n") * valid).cast("int"))
    return marked.select("half", "season", "episode", F.when((F.col("n") > 1) & (F.col("k") <= take), "valid").otherwise("train").alias("role"))


def episode_folds(rows: DataFrame) -> DataFrame:
    """Adds fold (from 0): all runs of an episode leave together."""
    folds = rows.select("season", "episode").distinct().withColumn("fold", (F.dense_rank().over(Window.orderBy("season", "episode")) - 1).cast("int"))  # one row an episode
    return rows.join(folds, ["season", "episode"])


def stratified_group_folds(rows: DataFrame, n_folds: int, seed: int = 42) -> DataFrame:
    """Adds fold: a season's episodes in hashed order go round the folds, with all their runs."""
    order = Window.partitionBy("season").orderBy(draw_hex(seed, "season", "episode"), "episode")
    folds = rows.select("season", "episode").distinct().withColumn("fold", ((F.row_number().over(order) - 1) % n_folds).cast("int"))
    return rows.join(folds, ["season", "episode"])


def eligible_shift(states: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(draw, run, tr, state): the turn of `circular_shift` among the rows that were kept, numbered anew in each run."""
    place = F.row_number().over(Window.partitionBy("run").orderBy("tr")) - 1
    drawn = states.select("run", place.alias("k"), F.count(F.lit(1)).over(Window.partitionBy("run")).alias("n"), "state").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    shift = F.when(F.col("n") > 1, (1 + F.floor(uniform(seed, "draw", "run") * (F.col("n") - 1))).cast("int")).otherwise(0)
    return drawn.select("draw", "run", F.pmod(F.col("k") + shift, F.col("n")).cast("int").alias("tr"), "state")


def of_role(rows: DataFrame, split: DataFrame, role: str) -> DataFrame:
    """The rows whose episode has that role."""
    return rows.join(split.where(F.col("role") == role).select("season", "episode"), ["season", "episode"], "left_semi")


def session_shuffle(runs: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(draw, session, run, slot): runs in hashed order within their session."""
    drawn = runs.select("season", "session", "run").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    order = Window.partitionBy("draw", "season", "session").orderBy(draw_hex(seed, "draw", "run"), "run")
    return drawn.withColumn("slot", F.row_number().over(order))

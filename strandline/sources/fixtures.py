"""Canonical tables from event logs, shipments and embeddings: states, runs, state vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("click", "error", "purchase", "signup", "view")
N_STATES = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states_from_events(events: DataFrame) -> DataFrame:
    """(run long, tr int, state int): the user's events in time order; the state is the kind and the value's decade."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, i) for i, k in enumerate(KINDS)])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(
        F.col("user_id").alias("run"), place.cast("int").alias("tr"), (kind * 10 + F.least(F.lit(9), F.floor(F.col("value") / 10))).cast("int").alias("state")
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states_from_events(table(spark, sf_dir, "events"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states by their kind alone: longer blocks, few labels."""
    return states(spark, sf_dir).withColumn("state", F.floor(F.col("state") / 10).cast("int"))


def with_run_fields(rows: DataFrame) -> DataFrame:
    """Adds season (1..6), part (a, b), episode and subject (0..2), which follow from the run number."""
    run = F.col("run")
    return (
        rows.withColumn("season", (run % 6 + 1).cast("int"))
        .withColumn("part", F.when(F.floor(run / 6) % 2 == 0, "a").otherwise("b"))
        .withColumn("episode", (F.floor(run / 12) + 1).cast("int"))
        .withColumn("subject", (run % 3).cast("int"))
    )


def shipments_as_states(lineitem: DataFrame) -> DataFrame:
    """A second stimulus: a supplier's shipments in date order, states from return flag and line status."""
    by = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return lineitem.select(F.col("l_suppkey").alias("run"), (F.row_number().over(by) - 1).cast("int").alias("tr"), (flag * 2 + (F.col("l_linestatus") == "O").cast("int")).cast("int").alias("state"))


def vectors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vec_id, dim, x) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def state_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, dim, mean, var): mean and population variance of the vectors of each label."""
    return vectors_long(spark, sf_dir).groupBy(F.col("label").alias("state"), "dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gamma, nc, seed, train_ll, valid_ll, k_active, n_train): a table of model fits, one a cell of shipments."""
    rows = table(spark, sf_dir, "lineitem")
    cell = rows.groupBy(
        (F.col("l_linenumber") % 3).cast("int").alias("gamma"), ((F.col("l_suppkey") % 4 + 1) * 10).cast("int").alias("nc"), (F.col("l_orderkey") % 5).cast("int").alias("seed")
    )
    return cell.agg(
        (-F.avg(F.col("l_extendedprice").cast("double")) / 1e4).alias("train_ll"), (-F.avg(F.col("l_quantity").cast("double")) / 5).alias("valid_ll"),
        F.countDistinct("l_discount").cast("int").alias("k_active"), F.count(F.lit(1)).alias("n_train"),
    )


def season_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gamma, nc, seed, season, valid_ll): the validation likelihood of each fit by season, from the same shipments."""
    rows = table(spark, sf_dir, "lineitem")
    cell = rows.groupBy(
        (F.col("l_linenumber") % 3).cast("int").alias("gamma"), ((F.col("l_suppkey") % 4 + 1) * 10).cast("int").alias("nc"), (F.col("l_orderkey") % 5).cast("int").alias("seed"), (F.col("l_partkey") % 6 + 1).cast("int").alias("season")
    )
    return cell.agg((-F.avg(F.col("l_quantity").cast("double")) / 5).alias("valid_ll"))

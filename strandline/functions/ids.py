"""Run identities: grammar, canonical forms, exclusive partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = r"^s(\d+)e(\d+)([a-z])$"


def run_id(season: Column, episode: Column, part: Column) -> Column:
    return F.format_string("s%02de%02d%s", season, episode, part)


def parsed_run(col: Column) -> dict[str, Column]:
    """season, episode and part of a run id; null where it does not follow the grammar."""
    field = lambda i: F.nullif(F.regexp_extract(col, RUN, i), F.lit(""))
    return {"season": field(1).cast("int"), "episode": field(2).cast("int"), "part": field(3)}


def canonical_run_id(col: Column) -> Column:
    """Short form of a run id: `ses-001_task-s01e02a` and `task-s1e2a` become s01e02a; others stay in lower case."""
    low = F.lower(F.trim(col))
    task = F.coalesce(F.nullif(F.regexp_extract(low, r"task-([a-z0-9]+)", 1), F.lit("")), low)
    got = r"^s0*(\d+)e0*(\d+)([a-z])$"
    return F.when(
        task.rlike(got), F.format_string("s%02de%02d%s", F.regexp_extract(task, got, 1).cast("int"), F.regexp_extract(task, got, 2).cast("int"), F.regexp_extract(task, got, 3))
    ).otherwise(task)


def pattern_partition(rows: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """Adds `subset`, the one pattern that a run id matches; an id that matches none or more than one is an error."""
    hits = F.array_compact(F.array(*[F.when(F.col(column).rlike(p), F.lit(name)) for name, p in patterns.items()]))
    return rows.withColumn("subset", F.when(F.size(hits) == 1, hits[0]).otherwise(F.raise_error(F.concat(F.lit("not in exactly one subset: "), F.col(column)))))

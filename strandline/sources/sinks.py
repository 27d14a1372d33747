"""Writers of records, pending work by fingerprint, and typed comparison of two outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(rows: DataFrame, path: str, sep: str = ",", compress: bool = False) -> None:
    """Rows as delimited text with a header; the write appears as a whole when its job commits."""
    writer = rows.write.option("header", True).option("sep", sep).option("emptyValue", "").mode("errorifexists")
    (writer.option("compression", "gzip") if compress else writer).csv(path)


def write_by(rows: DataFrame, path: str, by: list[str]) -> None:
    """Rows as Parquet in a folder a value of `by`; only the folders that have rows are replaced."""
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)


def fingerprint(*columns: str | Column) -> Column:
    """A digest of the settings that a result depends on; null differs from the empty text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("\x1f", *map(part, columns)), 256)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work items without a finished row of the same keys and fingerprint."""
    return work.join(done.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def differences(left: DataFrame, right: DataFrame, keys: list[str], atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """(keys, column, left, right, kind) of every cell that differs: 'missing' and 'extra' rows, 'structural' for texts,
    whole numbers, nulls and NaN or infinite values in one place only, 'numeric' beyond atol + rtol * |right|.

    Equal nulls, NaN and infinities agree. Columns must be the same on both sides, and so must their kinds.
    """
    names = [c for c in left.columns if c not in keys]
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    kinds, other = dict(left.dtypes), dict(right.dtypes)
    floats = {"float", "double"}
    changed = [c for c in names if (kinds[c] in floats) != (other[c] in floats) or (kinds[c] not in floats and kinds[c] != other[c])]
    if changed:
        raise ValueError(f"kinds differ: {changed}")
    a = left.select(*keys, F.struct(*names).alias("a"))
    b = right.select(*keys, F.struct(*names).alias("b"))
    both = a.join(b, keys, "full")
    cells = []
    for c in names:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if kinds[c] in floats:
            odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
            kind = F.when(odd(x) | odd(y), F.when(~x.eqNullSafe(y), "structural")).when(F.abs(x - y) > atol + rtol * F.abs(y), "numeric")
        else:
            kind = F.when(~x.eqNullSafe(y), "structural")
        whole = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise(kind)
        cells.append(F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"), whole.alias("kind")))
    return both.select(*keys, F.explode(F.array(*cells)).alias("d")).select(*keys, "d.*").where("kind is not null")

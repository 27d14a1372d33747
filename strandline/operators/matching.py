"""One-to-one assignment of states between fits, for many pairs of fits at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest one-to-one assignment of a rectangular cost table, rows ascending.

    Shortest augmenting paths over reduced costs: each row of the shorter side in turn takes the nearest column along
    a path that moves the earlier rows where that is cheaper.
    """
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for free in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, base = free, -1, 0.0
        while True:
            offer = base + c[row] - row_price[row] - col_price
            better = ~done & (offer < reach)
            reach[better], via[better] = offer[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            base = reach[column]
            done[column] = True
            if holder[column] < 0:
                break
            row = holder[column]
        seen = np.flatnonzero(done & (np.arange(m) != column))
        row_price[free] += base
        row_price[holder[seen]] += base - reach[seen]
        col_price[seen] -= base - reach[seen]
        while column >= 0:
            before = via[column]
            holder[column] = free if before < 0 else holder[before]
            column = before
    columns = np.flatnonzero(holder >= 0)
    a, b = (columns, holder[columns]) if turned else (holder[columns], columns)
    order = a.argsort()
    return a[order], b[order]


def matched(similarity: DataFrame, by: str, least: float = 0.3) -> DataFrame:
    """(by, a, b, r, passes) of rows (by, a, b, r): the assignment of a to b that costs least as 1 - r, in each pair of fits.

    Pairs of fits are groups of tasks; a group is one table of at most a hundred states a side. A pair (a, b) without
    a row has similarity -1. passes: r is `least` or more.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="a", columns="b", values="r", fill_value=-1.0).sort_index().sort_index(axis=1)
        r = table.to_numpy()
        i, j = assign(1.0 - r)
        return pd.DataFrame({by: rows[by].iloc[0], "a": table.index.to_numpy()[i], "b": table.columns.to_numpy()[j], "r": r[i, j]})

    kind = dict(similarity.dtypes)[by]
    out = similarity.select(by, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("r").cast("double").alias("r")).groupBy(by).applyInPandas(one, f"`{by}` {kind}, a long, b long, r double")
    return out.withColumn("passes", F.col("r") >= least)

"""Structured Streaming forms of the run operators: occupancy by window, sessions, and run-length blocks as they close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BLOCKS = "run long, state int, start_tr int, end_tr int"
_STATE = "state int, start_tr int, next_tr int"


def live_occupancy(states: DataFrame, window: str, late: str) -> DataFrame:
    """(window, run, state, n) of each window of a stream (run, state, ts), once it can no longer change.

    Rows later than `late` behind the newest are dropped by the watermark.
    """
    seen = states.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "run", "state").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("window", "run", "state", "n")


def live_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(subject, session, n_events) of a stream (subject, ts): a session ends after a pause of `gap`.

    A pause of exactly the gap ends it too, unlike the batch operator, where it must be longer.
    """
    by = F.session_window("ts", gap).alias("session")
    return events.withWatermark("ts", late).groupBy("subject", by).agg(F.count(F.lit(1)).alias("n_events"))


def live_blocks(states: DataFrame) -> DataFrame:
    """(run, state, start_tr, end_tr) of every block of a stream (run, tr, state) once another state follows it.

    A run's rows must come in order of tr over the batches; inside a batch they are sorted. A missing TR closes the
    block too. The state held a run is its open block alone; the last block of a run stays open.
    """

    def fold(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        closed = []
        for tr, state in pd.concat(list(rows))[["tr", "state"]].sort_values("tr").itertuples(index=False):
            if now is not None and (now[0] != state or now[2] != tr):
                closed.append((key[0], now[0], now[1], now[2]))
                now = None
            now = (int(state), int(tr) if now is None else now[1], int(tr) + 1)
        if now is not None:
            held.update(now)
        yield pd.DataFrame(closed, columns=["run", "state", "start_tr", "end_tr"])

    rows = states.select("run", "tr", "state")
    return rows.groupBy("run").applyInPandasWithState(fold, BLOCKS, _STATE, "append", GroupStateTimeout.NoTimeout)

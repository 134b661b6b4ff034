"""Streaming forms of the study operators. An extra: the batch forms are the contract.

Each takes a streaming (or batch) DataFrame and gives one; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaestio.operators.exams import EASE, LEAST_EASE, LONGEST, RIGHT, WRONG

OUT = "chave long, proxima_revisao date, intervalo_dias int, fator_facilidade double, acertos_seguidos int"
STATE = "existe boolean, intervalo int, facilidade int, seguidos int"


def next_state(state: tuple | None, right: bool) -> tuple:
    """One answer: (known, interval, ease in tenths, run)."""
    known, interval, ease, run = state or (False, 0, EASE, 0)
    if right:
        run += 1
        interval = 1 if run == 1 else 6 if run == 2 else min(LONGEST, round(interval * ease / 10))
        return True, interval, min(EASE, ease + RIGHT), run
    return True, 1, max(LEAST_EASE, ease + WRONG) if known else EASE, 0


def spaced_repetition(events: DataFrame) -> DataFrame:
    """The state of each key after its events so far: events has chave, quando, correta.

    Late answers are taken in the order they arrive within a batch's time order; a key's state is kept
    for as long as the query runs.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("quando", kind="stable")
        for right in rows.correta:
            now = next_state(now, bool(right))
        state.update(now)
        _, interval, ease, run = now
        due = rows.quando.iloc[-1].date() + pd.Timedelta(days=interval if run else 0)
        yield pd.DataFrame([[key[0], due, interval, ease / 10, run]], columns=["chave", "proxima_revisao", "intervalo_dias", "fator_facilidade", "acertos_seguidos"])

    known = events.where("correta IS NOT NULL AND quando IS NOT NULL").select("chave", "quando", "correta")
    return known.groupBy("chave").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def study_sessions(events: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(chave, inicio, fim, n): event-time sessions; an event exactly ``gap`` after the last still belongs."""
    s = events.withWatermark("quando", late).groupBy("chave", F.session_window("quando", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("chave", F.col("s.start").alias("inicio"), F.col("s.end").alias("fim"), "n")


def running_accuracy(events: DataFrame) -> DataFrame:
    """(chave, total, acertos) so far; for update or complete mode."""
    return events.groupBy("chave").agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"))


def latest_progress(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Progress rows without repeats of (chave, n), by event time; what is later than ``late`` is dropped."""
    return events.withWatermark("quando", late).dropDuplicatesWithinWatermark(["chave", "n"])

"""Live sessions: history and tail as one sequence, with state that is forgotten in time.

State is kept by ``transformWithStateInPandas`` in RocksDB: a batch touches the entries
that its rows are about, whatever a session holds. The first time, a stream's state is
that of the history, which is given as a batch; after a restart it is the checkpoint's.
So the history's rows, numbered by ``events.sequenced``, and the tail's are one sequence
without gaps. A session that is over is forgotten a time after its last event, and a
unit of a document a time after it was read last: by the clock, so a query looks at its
state also when there is nothing new, and doesn't end by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.coverage import new_units, read_streaks
from ..operators.events import RETENTION_MINUTES, STATES, TERMINAL, final_states

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OVER = ("completed", "error")
SEQUENCED = "session_id bigint, event_id bigint, ts timestamp, type string, data string, sequence bigint, state string, last boolean"
STREAKS = "session_id bigint, turn bigint, new_units bigint, streak bigint, stale boolean"


def keep_state(spark: SparkSession) -> None:
    """Set the state store that these streams need; before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Sessions(StatefulProcessor):
    """The sequence and state of each session's events."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = "sequence bigint, state string"
        self.open = handle.getValueState("open", kept)
        # what is over stays for a while, for events that come late and clients that come back
        self.over = handle.getValueState("over", kept, ttlDurationMs=int(self.minutes * 60_000))

    def _put(self, sequence: int, state: str) -> None:
        if state in OVER:
            self.open.clear()
            self.over.update((sequence, state))
        else:
            self.open.update((sequence, state))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for n, state in zip(initialState["sequence"], initialState["state"], strict=True):
            self._put(int(n), state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        n, state = self.open.get() or self.over.get() or (0, "created")
        numbers, states = [], []
        for kind in new["type"]:
            n, state = n + 1, state if state in OVER else STATES.get(kind, state)
            numbers.append(n)
            states.append(state)
        self._put(n, state)
        yield new[["session_id", "event_id", "ts", "type", "data"]].assign(sequence=numbers, state=states, last=new["type"].isin(TERMINAL))

    def close(self) -> None:
        pass


def live_events(events: DataFrame, history: DataFrame, minutes: int = RETENTION_MINUTES) -> DataFrame:
    """A stream of events with sequence, state and whether a client stops behind it; ``history``: the events before it."""
    keep_state(events.sparkSession)
    known = final_states(history).join(history.groupBy("session_id").agg(F.count("*").alias("sequence")), "session_id").select("session_id", "sequence", "state")
    return events.groupBy("session_id").transformWithStateInPandas(_Sessions(minutes), SEQUENCED, "Append", "ProcessingTime", initialState=known.groupBy("session_id"))


class _Coverage(StatefulProcessor):
    """Which units a session has read, and how many turns in a row have read none that is new."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        # an entry for each unit: a batch reads and writes those that its rows name
        self.seen = handle.getMapState("seen", "doc_id string, unit_no bigint", "turn bigint", ttlDurationMs=int(self.minutes * 60_000))
        self.streak = handle.getValueState("streak", "streak bigint", ttlDurationMs=int(self.minutes * 60_000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for doc, unit, turn, streak in zip(initialState["doc_id"], initialState["unit_no"], initialState["turn"], initialState["streak"], strict=True):
            if doc is None or pd.isna(unit):
                self.streak.update((int(streak),))
            else:
                self.seen.updateValue((str(doc), int(unit)), (int(turn),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, out = (self.streak.get() or (0,))[0], []
        for turn, group in pd.concat(list(rows)).sort_values("turn").groupby("turn"):
            fresh = 0
            units = {(str(d), int(u)) for d, u in zip(group["doc_id"], group["unit_no"], strict=True) if d is not None and not pd.isna(u) and u > 0}
            for unit in units:
                fresh += not self.seen.containsKey(unit)
                self.seen.updateValue(unit, (int(turn),))
            streak = 0 if fresh or (group["kind"] == "search").any() else streak + 1
            out.append((key[0], int(turn), fresh, streak, streak >= 2))
        self.streak.update((streak,))
        yield pd.DataFrame(out, columns=["session_id", "turn", "new_units", "streak", "stale"])

    def close(self) -> None:
        pass


def live_coverage(reads: DataFrame, history: DataFrame, minutes: int = 24 * 60) -> DataFrame:
    """session_id, turn, new_units, streak, stale of a stream of reads (session_id, turn, kind, doc_id, unit_no), turn by turn.

    ``history``: the reads before it. A unit that isn't read for ``minutes`` counts as new again.
    """
    keep_state(reads.sparkSession)
    turns = history.groupBy("session_id", "turn").agg(F.coalesce(F.max(F.when(F.col("kind") == "search", "search")), F.lit("read")).alias("kind"))
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    streaks = read_streaks(turns, history.where("doc_id is not null")).withColumn("_n", last).where("_n = 1")
    units = new_units(history.where("doc_id is not null")).select("session_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("unit_no").cast("bigint").alias("unit_no"), F.col("turn").cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("streak"))
    known = units.unionByName(streaks.select("session_id", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("bigint").alias("unit_no"), F.col("turn").cast("bigint").alias("turn"), F.col("streak").cast("bigint").alias("streak")))
    return reads.groupBy("session_id").transformWithStateInPandas(_Coverage(minutes), STREAKS, "Append", "ProcessingTime", initialState=known.groupBy("session_id"))

"""Session logs as streams: the same answers as the batch operators, kept up to date.

A stream first reads the history, then what is appended. Watermarks are ours; they
bound the state that is kept, and late events beyond them are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import RETENTION_MINUTES, STATES, TERMINAL

EVENTS = "event_id bigint, session_id bigint, ts timestamp, type string, data string"


def read_events(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """Events appended to a folder as Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(folder)


def counts_by_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of each type in windows of time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "type", "events")


def session_states(events: DataFrame, minutes: int = RETENTION_MINUTES, late: str = "30 minutes") -> DataFrame:
    """session_id, state, sequence, last_event after each batch; sessions that are over and idle are forgotten.

    Idle time is that of the events, so a replay forgets what the first run did.
    """
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, n, last = state.get if state.exists else ("created", 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["type"]:
            n += 1
            if name not in ("completed", "error"):
                name = STATES.get(kind, name)
        last = max(last, int(rows.ts.max().timestamp() * 1e6))
        state.update((name, n, last))
        if name in ("completed", "error"):
            state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "state": [name], "sequence": [n], "last_event": [pd.Timestamp(last, unit="us")]})

    return events.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(advance, "session_id bigint, state string, sequence bigint, last_event timestamp", "state string, sequence bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def coverage_streaks(reads: DataFrame) -> DataFrame:
    """session_id, turn, new_units, streak, stale of reads (session_id, turn, kind, doc_id, unit_no), turn by turn.

    The units seen are kept with the session, which reads a bounded set of documents.
    """
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, seen = state.get if state.exists else (0, [])
        known = set(seen)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, group in rows.groupby("turn"):
            units = {f"{d}:{u}" for d, u in zip(group.doc_id, group.unit_no, strict=True) if not pd.isna(u) and u > 0}
            fresh = units - known
            known |= units
            streak = 0 if fresh or (group.kind == "search").any() else streak + 1
            out.append((key[0], turn, len(fresh), streak, streak >= 2))
        state.update((streak, sorted(known)))
        yield pd.DataFrame(out, columns=["session_id", "turn", "new_units", "streak", "stale"])

    return reads.groupBy("session_id").applyInPandasWithState(advance, "session_id bigint, turn bigint, new_units bigint, streak bigint, stale boolean", "streak bigint, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def frames_until_over(events: DataFrame) -> DataFrame:
    """Wire frames of a stream of sequenced events; a client stops after a terminal one, which is marked."""
    payload = F.to_json(F.struct("session_id", "type", "data"))
    return events.select("session_id", "event_id", F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), payload, F.lit("\n\n")).alias("frame"), F.col("type").isin(*TERMINAL).alias("last"))

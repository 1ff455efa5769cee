"""Live sessions against the batch operators over all that has happened."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tamarack.operators import coverage, events as batch
from tamarack.streaming import live

EVENTS = "session_id bigint, event_id bigint, ts timestamp, type string, data string"
READS = "session_id bigint, turn bigint, kind string, doc_id string, unit_no bigint"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield spark
    spark.conf.set(key, before)


def ran(stream, tmp_path, name):
    """One run to the end of what there is: each call is a restart. (State that is forgotten by the clock makes batches without end.)"""
    q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/{name}")).option("checkpointLocation", f"{tmp_path}/{name}-cp").outputMode("append").trigger(processingTime="1 second").start()
    until = time.time() + 150
    while time.time() < until and not (q.exception() or (any(p.numInputRows for p in q.recentProgress) and not q.lastProgress.numInputRows)):
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None and time.time() < until
    return stream.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_replay_and_tail_are_one_sequence(rocks, tmp_path):
    spark, r = rocks, random.Random(2)
    kinds = ["start", "tool_call", "ask_human", "human_reply", "complete", "error", "note"]
    rows = [(r.randrange(12), i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", r.choice(kinds[:4] + kinds[6:] if i < 250 else kinds), "{}") for i in range(400)]
    every = spark.createDataFrame(rows, "session_id bigint, event_id bigint, ts string, type string, data string").withColumn("ts", F.col("ts").cast("timestamp"))
    history = every.where("event_id < 150")
    for low, high in ((150, 230), (230, 330), (330, 400)):  # each part comes after a restart
        every.where(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        tail = ran(live.live_events(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/log"), history), tmp_path, "out")
    both = batch.sequenced(history).select("session_id", "event_id", "sequence").unionByName(tail.select("session_id", "event_id", "sequence"))
    want = {(x["session_id"], x["event_id"]): x["sequence"] for x in batch.sequenced(every).collect()}
    got = {(x["session_id"], x["event_id"]): x["sequence"] for x in both.collect()}
    assert got == want and both.count() == 400
    last = {x["session_id"]: x["state"] for x in tail.groupBy("session_id").agg(F.max_by("state", "sequence").alias("state")).collect()}
    assert last == {x["session_id"]: x["state"] for x in batch.final_states(every).collect() if x["session_id"] in last}
    assert {x["type"] for x in tail.where("last").collect()} <= {"complete", "error"}


def test_coverage_goes_on_from_the_history(rocks, tmp_path):
    spark, r = rocks, random.Random(3)
    rows = [(s, t, r.choice(["parse", "parse", "search", None]), r.choice(["a", "b", None]), r.choice([None, 0, 1, 2, 3])) for s in range(6) for t in range(30) for _ in range(r.randrange(1, 3))]
    every = spark.createDataFrame(rows, READS)
    history = every.where("turn < 10")
    for low, high in ((10, 20), (20, 30)):
        every.where(f"turn >= {low} and turn < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        got = ran(live.live_coverage(spark.readStream.schema(READS).parquet(f"{tmp_path}/log"), history), tmp_path, "out")
    turns = every.groupBy("session_id", "turn").agg(F.coalesce(F.max(F.when(F.col("kind") == "search", "search")), F.lit("read")).alias("kind"))
    want = {tuple(x) for x in coverage.read_streaks(turns, every.where("doc_id is not null")).where("turn >= 10").collect()}
    assert {tuple(x) for x in got.select("session_id", "turn", "new_units", "streak", "stale").collect()} == want


def test_what_is_not_read_is_forgotten(rocks, tmp_path):
    spark = rocks
    history = spark.createDataFrame([(1, 1, "parse", "a", 1)], READS)
    for turn in (2, 3):  # the second comes later than what is kept for ten milliseconds
        spark.createDataFrame([(1, turn, "parse", "a", 1)], READS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        reads = spark.readStream.schema(READS).parquet(f"{tmp_path}/log")
        kept = ran(live.live_coverage(reads, history), tmp_path, "kept")
        short = ran(live.live_coverage(reads, history, minutes=1 / 6000), tmp_path, "short")
    assert [r["new_units"] for r in kept.orderBy("turn").collect()] == [0, 0]
    assert [r["new_units"] for r in short.orderBy("turn").collect()] == [0, 1]

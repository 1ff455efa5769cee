"""Session logs: sequence, state, retention, traces, citations, wire format, totals.

Events are (session_id, event_id, ts, type, data), data being JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TERMINAL = ("complete", "error")
#: The state a session is in after an event; other events don't change it.
STATES = {"start": "running", "ask_human": "awaiting_human", "human_reply": "running", "complete": "completed", "error": "error"}
FILE_TOOLS = ("read", "grep", "preview_file", "parse_file")
RETENTION_MINUTES = 15


def sequenced(events: DataFrame) -> DataFrame:
    """events with ``sequence`` from 1 on in each session."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")))


def state_after(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[kind]


def final_states(events: DataFrame) -> DataFrame:
    """session_id, state, last_event: the state of each session; nothing changes it once it is over."""
    order = F.struct("ts", "event_id")
    over = events.groupBy("session_id").agg(F.min_by("type", F.when(F.col("type").isin(*TERMINAL), order)).alias("ended"), F.max_by("type", F.when(state_after(F.col("type")).isNotNull(), order)).alias("last"), F.max("ts").alias("last_event"))
    return over.select("session_id", F.coalesce(state_after(F.col("ended")), state_after(F.col("last")), F.lit("created")).alias("state"), "last_event")


def illegal_replies(events: DataFrame) -> DataFrame:
    """Replies of sessions that weren't waiting for one."""
    before = F.last(F.when(F.col("type").isin(*STATES), state_after(F.col("type"))), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", F.coalesce(before, F.lit("created"))).where("type = 'human_reply' and _before <> 'awaiting_human'").drop("_before")


def retained(events: DataFrame, now: Column, minutes: int = RETENTION_MINUTES) -> DataFrame:
    """Sessions that stay: all but those that are over and idle for longer."""
    states = final_states(events)
    return states.where(~(F.col("state").isin("completed", "error") & (F.col("last_event") < now - F.expr(f"interval {minutes} minutes"))))


def trace_steps(events: DataFrame) -> DataFrame:
    """session_id, step, entry: a line for each tool call and change of directory."""
    data = lambda k: F.nullif(F.get_json_object("data", f"$.{k}"), F.lit(""))
    rows = events.where(F.col("type").isin("tool_call", "go_deeper"))
    step = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    named = [F.concat(F.lit(f"{label}="), data(key)) for label, key in (("directory", "directory"), ("file", "file_path"), ("document", "document"))]
    paths = F.concat_ws(", ", *named)
    call = F.concat(F.lit("tool:"), F.coalesce(data("tool"), F.lit("")), F.lit(" ("), F.when(paths == "", "no-path-args").otherwise(paths), F.lit(")"))
    deeper = F.concat(F.lit("godeeper (directory="), F.coalesce(data("directory"), F.lit("")), F.lit(")"))
    return rows.withColumn("step", step).select("session_id", "step", F.concat(F.col("step").cast("string"), F.lit(". "), F.when(F.col("type") == "tool_call", call).otherwise(deeper)).alias("entry"))


def referenced_documents(events: DataFrame) -> DataFrame:
    """session_id, documents: the sorted files that file tools were given."""
    calls = events.where("type = 'tool_call'").select("session_id", F.get_json_object("data", "$.tool").alias("tool"), F.get_json_object("data", "$.file_path").alias("file"), F.get_json_object("data", "$.document").alias("document"))
    files = calls.where(F.col("tool").isin(*FILE_TOOLS)).select("session_id", F.col("file").alias("path")).unionByName(calls.select("session_id", F.col("document").alias("path")))
    return files.where("path is not null and path <> ''").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("documents"))


def repeated_calls(calls: DataFrame) -> DataFrame:
    """calls (session_id, step, signature) with repeated, and stops where two in a row repeat the one before."""
    order = Window.partitionBy("session_id").orderBy("step")
    marked = calls.withColumn("repeated", F.coalesce(F.lag("signature").over(order) == F.col("signature"), F.lit(False)))
    return marked.withColumn("stops", F.col("repeated") & F.coalesce(F.lag("repeated").over(order), F.lit(False)))


def sse_frames(events: DataFrame) -> DataFrame:
    """session_id, sequence, frame: events in the wire format of server-sent events."""
    payload = F.to_json(F.struct("session_id", "sequence", "type", "data"))
    return sequenced(events).select("session_id", "sequence", F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), payload, F.lit("\n\n")).alias("frame"))


def token_usage(usage: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """session_id with sums of tokens and their cost, at prices for a million."""
    out = usage.groupBy("session_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return out.withColumn("cost", F.round(F.col("input_tokens") / 1e6 * input_price + F.col("output_tokens") / 1e6 * output_price, 6))

"""Plans by which a session steers its context: active ranges, promoted evidence, stale ranges, gaps.

``plans`` are (session_id, turn, operation, document_id, file_path, ranges, evidence_ids,
note), at most one a turn; ``ranges`` is array<struct<start_unit, end_unit>>. All of a
session's plans are applied at once by windows over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The operations, those that set the active scope, what is said of others, and of missing evidence.
SCOPING = ("keep_ranges", "expand_range", "narrow_to_range", "switch_document")
PROMOTE, SUMMARIZE, STOP = "promote_evidence_units", "summarize_stale_ranges", "stop_insufficient_evidence"
OUTSIDE, NO_DOCUMENT, UNSUPPORTED = "document is outside the selected scope", "no document available to summarize", "unsupported context operation"
INSUFFICIENT = "Evidence is still insufficient after automatic context compaction."


def _given(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def judged_plans(plans: DataFrame, selected: DataFrame) -> DataFrame:
    """plans with the active scope after each turn, applied and error; those without an operation are none.

    ``selected`` (session_id, document_id): the documents a session may use. The scope
    starts without a document; an operation that sets it keeps what it doesn't name.
    """
    mine = selected.select("session_id", "document_id").distinct()
    asked = plans.withColumn("operation", _given("operation")).withColumn("document_id", _given("document_id")).withColumn("file_path", _given("file_path")).where("operation is not null")
    known = asked.join(mine.withColumn("_known", F.lit(True)), ["session_id", "document_id"], "left")
    outside = F.col("document_id").isNotNull() & F.col("_known").isNull()
    sets = F.col("operation").isin(*SCOPING) & ~outside
    upto = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, when: F.last(F.when(sets & when, c), ignorenulls=True).over(upto)
    scoped = known.select(
        "*",
        last(F.col("document_id"), F.col("document_id").isNotNull()).alias("active_document_id"),
        last(F.col("file_path"), F.col("file_path").isNotNull()).alias("active_file_path"),
        last(F.col("ranges"), F.size("ranges") > 0).alias("active_ranges"),
        outside.alias("_outside"),
    )
    # a document that was selected is known, be it named by this plan or by one before
    summed = F.coalesce("document_id", "active_document_id")
    error = F.when(F.col("_outside"), OUTSIDE).when((F.col("operation") == SUMMARIZE) & summed.isNull(), NO_DOCUMENT).when(~F.col("operation").isin(*SCOPING, PROMOTE, SUMMARIZE, STOP), UNSUPPORTED)
    return scoped.withColumn("error", error).withColumn("applied", F.col("error").isNull()).drop("_known", "_outside")


def promoted_evidence(judged: DataFrame, evidence: DataFrame) -> DataFrame:
    """session_id, evidence_id, turn: known evidence by the first plan that promotes it."""
    named = judged.where((F.col("operation") == PROMOTE) & F.col("applied")).select("session_id", "turn", F.explode("evidence_ids").alias("evidence_id"))
    return named.join(evidence.select("session_id", "evidence_id").distinct(), ["session_id", "evidence_id"]).groupBy("session_id", "evidence_id").agg(F.min("turn").alias("turn"))


def summarized_ranges(judged: DataFrame, covered: DataFrame) -> DataFrame:
    """session_id, turn, document_id, range_start, range_end: covered ranges that aren't active when a plan sums them up.

    Only the active document's ranges count here; summarized_document_ranges has those of every document.
    """
    sums = judged.where((F.col("operation") == SUMMARIZE) & F.col("applied")).select("session_id", "turn", F.coalesce("document_id", "active_document_id").alias("document_id"), "active_document_id", "active_ranges")
    both = sums.join(covered, ["session_id", "document_id"])
    here = F.col("active_document_id") == F.col("document_id")
    active = F.exists(F.coalesce("active_ranges", F.array().cast("array<struct<start_unit:int,end_unit:int>>")), lambda r: (r["start_unit"] == F.col("range_start")) & (r["end_unit"] == F.col("range_end")))
    return both.where(~F.coalesce(here & active, F.lit(False))).select("session_id", "turn", "document_id", "range_start", "range_end")


def summarized_document_ranges(judged: DataFrame, covered: DataFrame) -> DataFrame:
    """As summarized_ranges, with the active ranges that each document had when it was the active one last.

    A switch to another document leaves those of the one before as they were.
    """
    scoping = F.col("operation").isin(*SCOPING) & F.col("applied")
    sets = judged.where(scoping).select("session_id", F.col("active_document_id").alias("document_id"), "turn", F.coalesce("active_ranges", F.array().cast("array<struct<start_unit:int,end_unit:int>>")).alias("set"))
    sums = judged.where((F.col("operation") == SUMMARIZE) & F.col("applied")).select("session_id", F.coalesce("document_id", "active_document_id").alias("document_id"), "turn", F.lit(None).cast("array<struct<start_unit:int,end_unit:int>>").alias("set"))
    before = Window.partitionBy("session_id", "document_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = sets.withColumn("_sum", F.lit(False)).unionByName(sums.withColumn("_sum", F.lit(True))).withColumn("active", F.last("set", ignorenulls=True).over(before)).where("_sum")
    active = F.exists("active", lambda r: (r["start_unit"] == F.col("range_start")) & (r["end_unit"] == F.col("range_end")))
    return asked.join(covered, ["session_id", "document_id"]).where(~F.coalesce(active, F.lit(False))).select("session_id", "turn", "document_id", "range_start", "range_end")


def gaps(judged: DataFrame) -> DataFrame:
    """session_id, turn, message of the plans that give up."""
    return judged.where((F.col("operation") == STOP) & F.col("applied")).select("session_id", "turn", F.coalesce(_given("note"), F.lit(INSUFFICIENT)).alias("message"))

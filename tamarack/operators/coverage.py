"""Evidence: which units of documents were asked for, read, are missing, or bring nothing new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def unit_ranges(units: DataFrame, keys: list[str], unit_col: str = "unit_no") -> DataFrame:
    """keys, range_start, range_end: maximal runs of consecutive positive units."""
    distinct = units.where(F.col(unit_col) > 0).select(*keys, unit_col).distinct()
    island = F.col(unit_col) - F.row_number().over(Window.partitionBy(*keys).orderBy(unit_col))
    return distinct.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(unit_col).alias("range_start"), F.max(unit_col).alias("range_end")).drop("_island")


def requested_units(requests: DataFrame) -> DataFrame:
    """session_id, doc_id, unit_no of requests (session_id, doc_id, anchor, window), from unit 1 on."""
    low, high = F.greatest(F.col("anchor") - F.col("window"), F.lit(1)), F.col("anchor") + F.col("window")
    return requests.where(high >= 1).select("session_id", "doc_id", F.explode(F.sequence(low, high)).alias("unit_no")).distinct()


def missing_units(requested: DataFrame, retrieved: DataFrame, totals: DataFrame) -> DataFrame:
    """Units asked for that exist (totals: doc_id, total_units, null if not known) and weren't read."""
    known = requested.join(totals, "doc_id", "left").where("total_units is null or unit_no <= total_units")
    return known.join(retrieved, ["session_id", "doc_id", "unit_no"], "left_anti").select("session_id", "doc_id", "unit_no")


def new_units(reads: DataFrame) -> DataFrame:
    """reads (session_id, turn, doc_id, unit_no) that show a unit for the first time in the session."""
    first = F.row_number().over(Window.partitionBy("session_id", "doc_id", "unit_no").orderBy("turn"))
    return reads.where("unit_no > 0").withColumn("_n", first).where("_n = 1").drop("_n")


def read_streaks(turns: DataFrame, reads: DataFrame) -> DataFrame:
    """session_id, turn, new_units, streak, stale: how many turns in a row have read nothing new.

    ``turns`` (session_id, turn, kind): a search with hits, kind 'search', resets the
    streak; two in a row without news make the active range stale.
    """
    fresh = new_units(reads).groupBy("session_id", "turn").agg(F.count("*").alias("new_units"))
    marked = turns.join(fresh, ["session_id", "turn"], "left").withColumn("new_units", F.coalesce("new_units", F.lit(0)))
    reset = (F.col("new_units") > 0) | (F.col("kind") == "search")
    by_turn = Window.partitionBy("session_id").orderBy("turn")
    marked = marked.withColumn("_island", F.sum(reset.cast("int")).over(by_turn))
    streak = F.sum((~reset).cast("int")).over(Window.partitionBy("session_id", "_island").orderBy("turn"))
    return marked.withColumn("streak", streak).select("session_id", "turn", "new_units", "streak", (F.col("streak") >= 2).alias("stale"))


def stale_ranges(covered: DataFrame, active: DataFrame) -> DataFrame:
    """Covered ranges that aren't among the active ones, as ranges, not units."""
    return covered.join(active, ["session_id", "doc_id", "range_start", "range_end"], "left_anti")


def active_evidence(evidence: DataFrame, active: DataFrame) -> DataFrame:
    """Evidence whose unit lies in an active range of its document."""
    inside = (evidence.session_id == active.session_id) & (evidence.doc_id == active.doc_id) & evidence.unit_no.between(active.range_start, active.range_end)
    return evidence.join(active, inside, "left_semi")


def ranked_evidence(evidence: DataFrame, anchor: int | None = None) -> DataFrame:
    """evidence with rank: cited, promoted, near the anchor, then by whole scores."""
    distance = F.coalesce(F.abs(F.col("unit_no") - anchor), F.lit(9999)) if anchor is not None else F.lit(9999)
    order = Window.partitionBy("session_id").orderBy(F.desc("cited"), F.desc("promoted"), distance, (-F.coalesce("score", F.lit(0.0))).cast("int"), "evidence_id")
    return evidence.withColumn("rank", F.row_number().over(order))


def upsert_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence with the new rows in place of old ones of the same id."""
    return old.join(new, ["session_id", "evidence_id"], "left_anti").unionByName(new)


def last_notes(notes: DataFrame, most: dict[str, int]) -> DataFrame:
    """The last notes of each kind (session_id, kind, turn, text), as many as ``most`` says."""
    limit = F.create_map(*(F.lit(x) for kv in most.items() for x in kv))[F.col("kind")]
    place = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy(F.desc("turn")))
    return notes.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")

"""Logical units: splitting, selection, headers and footers, focused rendering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrow import rows_of_texts
from ..functions.scoring import unit_score
from ..functions.text import SPACE, derive_heading, normalize_markdown, strip

#: Characters a unit aims at, and must have before a longer one is cut.
TARGET, LEAST = 1600, 450


def _heading(block: str) -> str | None:
    lines = block.split("\n")
    for line in lines:
        if line.strip(SPACE).startswith("#"):
            return line.strip(SPACE).lstrip("#").strip(SPACE) or None
    first = lines[0].strip(SPACE)
    return first if 1 <= len(first) <= 90 else None


def unit_rows(text: str) -> Iterator[tuple[int, str, str, str | None, str]]:
    """The units of a normalised text: blocks gathered until a heading or the size says that one is full."""
    held: list[str] = []
    size, units = 0, []
    for block in filter(None, text.split("\n\n")):
        full = size + len(block) + 2 > TARGET and size >= LEAST
        if held and (full or block.startswith("#")):
            units.append(held)
            held, size = [], 0
        size += len(block) + (2 if held else 0)
        held.append(block)
    for number, blocks in enumerate([*units, held] if held else units, 1):
        body = "\n\n".join(blocks)
        heading = next((h for h in map(_heading, blocks) if h), None)
        yield number, body, hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), heading, f"unit-{number}"


def logical_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, unit_no, markdown, content_hash, heading, source_locator; none for blank texts."""
    named = docs.select(F.col(id_col).alias("id"), normalize_markdown(F.col(text_col)).alias("body"))
    made = rows_of_texts(named, "body", unit_rows, "unit_no int, markdown string, content_hash string, heading string, source_locator string", 1)
    return made.withColumnRenamed("id", id_col)


def whole_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Logical units, and for a document without any one empty unit, so that every document has some."""
    found = logical_units(docs, id_col, text_col)
    bare = docs.where(F.coalesce(normalize_markdown(F.col(text_col)), F.lit("")) == "").select(id_col, F.lit(1).alias("unit_no"), F.lit("").alias("markdown"), F.sha2(F.lit(""), 256).alias("content_hash"), F.lit(None).cast("string").alias("heading"), F.lit("unit-1").alias("source_locator"))
    return found.unionByName(bare)


def single_unit(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document as one unit."""
    body = normalize_markdown(F.col(text_col))
    return docs.select(id_col, F.lit(1).alias("unit_no"), body.alias("markdown"), F.sha2(body, 256).alias("content_hash"), derive_heading(body).alias("heading"), F.lit("unit-1").alias("source_locator"))


def select_units(units: DataFrame, id_col: str = "doc_id", unit_nos: list[int] | None = None, anchor: int | None = None, window: int = 1, query: str | None = None, max_units: int | None = None) -> DataFrame:
    """Units named, near the anchor, or among the document's best four for the query; all if that is none.

    With ``max_units`` those nearest to the anchor stay, then those that score more, then earlier ones.
    """
    score = unit_score(F.col("markdown"), query) if query else F.lit(0)
    scored = units.withColumn("_score", score)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("_score"), "unit_no"))
    chosen: Column = F.lit(False)
    if unit_nos:
        chosen = chosen | F.col("unit_no").isin(*unit_nos)
    if anchor is not None:
        chosen = chosen | (F.abs(F.col("unit_no") - anchor) <= max(window, 0))
    if query:
        scored = scored.withColumn("_rank", rank)
        chosen = chosen | ((F.col("_rank") <= 4) & (F.col("_score") > 0))
    flagged = scored.withColumn("_chosen", chosen)
    flagged = flagged.withColumn("_any", F.bool_or("_chosen").over(Window.partitionBy(id_col))).where("_chosen or not _any")
    if max_units:
        order = Window.partitionBy(id_col).orderBy(F.abs(F.col("unit_no") - anchor) if anchor is not None else F.lit(0), F.desc("_score"), "unit_no")
        flagged = flagged.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= max_units)
    return flagged.select(units.columns)


#: Windows that are tried after the one asked for.
WIDER = (2, 4, 8)


def focused_units(units: DataFrame, anchor: int, window: int, id_col: str = "doc_id") -> DataFrame:
    """Units near the anchor, in the first of ``window`` and WIDER that has any of the document; the whole document where none has."""
    distance = F.abs(F.col("unit_no") - anchor)
    nearest = F.min(distance).over(Window.partitionBy(id_col))
    within = F.get(F.filter(F.array(*(F.lit(w) for w in (max(window, 0), *WIDER))), lambda w: w >= F.col("_nearest")), F.lit(0))
    chosen = units.withColumn("_nearest", nearest).withColumn("_within", within)
    return chosen.where(F.col("_within").isNull() | (distance <= F.col("_within"))).select(units.columns)


def strip_headers_and_footers(pages: DataFrame, id_col: str, text_col: str = "markdown") -> DataFrame:
    """pages (id, page_no, text) with first and last lines blanked that two pages of the document share, then page numbers at the end."""
    lines = F.transform(F.split(F.col(text_col), "\r\n|\n|\r"), lambda x: F.rtrim(x, F.lit(SPACE)))
    full = lambda a: F.transform(F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: strip(s["x"]) != ""), lambda s: s["i"])
    with_lines = pages.withColumn("_lines", lines)
    ends = with_lines.withColumn("_full", full(F.col("_lines")))
    at = lambda i: F.get(F.col("_lines"), i)
    ends = ends.withColumn("_top", F.get("_full", F.lit(0))).withColumn("_end", F.get("_full", F.size("_full") - 1))
    ends = ends.withColumn("_head", at(F.col("_top"))).withColumn("_foot", at(F.col("_end")))
    repeated = lambda c: F.when(F.length(strip(F.col(c))) <= 120, F.count(F.when(F.length(strip(F.col(c))) <= 120, 1)).over(Window.partitionBy(id_col, c)) >= 2).otherwise(False)
    ends = ends.withColumn("_cut_head", F.coalesce(repeated("_head"), F.lit(False))).withColumn("_cut_foot", F.coalesce(repeated("_foot"), F.lit(False)))

    def blank(lines_: Column, index: Column, when: Column) -> Column:
        return F.transform(lines_, lambda x, i: F.when(when & (i == index), "").otherwise(x))

    ends = ends.withColumn("_lines", blank(F.col("_lines"), F.col("_top"), F.col("_cut_head")))
    # the last line that is left may be the first, just blanked
    ends = ends.withColumn("_left", full(F.col("_lines"))).withColumn("_end", F.get("_left", F.size("_left") - 1))
    shared_foot = F.col("_cut_foot") & (at(F.col("_end")) == F.col("_foot"))
    ends = ends.withColumn("_lines", blank(F.col("_lines"), F.col("_end"), F.coalesce(shared_foot, F.lit(False))))
    ends = ends.withColumn("_left", full(F.col("_lines"))).withColumn("_end", F.get("_left", F.size("_left") - 1))
    compact = F.regexp_replace(F.coalesce(at(F.col("_end")), F.lit("")), r"\s+", "")
    no = F.col("page_no").cast("string")
    # fixed patterns of a page number: alone, in marks, in Chinese, n of m either way round, with a slash or a dash
    bare = F.regexp_replace(compact, "^[-_~·•]*|[-_~·•]*$", "") == no
    of = (F.regexp_extract(compact, r"^(\d+)[/-]\d+$", 1) == no) | (F.regexp_extract(compact, r"^\d+[/-](\d+)$", 1) == no)
    number = bare | of | (compact == F.concat(F.lit("第"), no, F.lit("页")))
    ends = ends.withColumn("_lines", blank(F.col("_lines"), F.col("_end"), number & (compact != "")))
    return ends.select(*[F.array_join("_lines", "\n").alias(text_col) if c == text_col else F.col(c) for c in pages.columns])


def render_units(units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, rendered: the units of each document with a line that names each."""
    block = F.concat(F.lit("[UNIT "), F.col("unit_no").cast("string"), F.lit(" | "), F.coalesce("source_locator", F.lit("")), F.lit(" | "), F.coalesce("heading", F.lit("")), F.lit("]\n"), F.col("markdown"))
    parts = F.array_sort(F.collect_list(F.struct("unit_no", block.alias("block"))))
    return units.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("rendered"))


def rebuilt_documents(units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, markdown: non-blank units in order, joined by blank lines."""
    kept = units.where(strip(F.col("markdown")) != "")
    parts = F.array_sort(F.collect_list(F.struct("unit_no", "markdown")))
    return kept.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["markdown"]), "\n\n").alias("markdown"))

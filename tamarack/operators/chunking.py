"""Chunks of documents, units joined to documents, and which unit a chunk is from."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrow import rows_of_texts

SIZE, OVERLAP = 1500, 150
_SPACE = " \t\n\r\x0c\x0b"
_BLANK_LINE = re.compile("(?=\n\n)")


def chunk_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk: ``size`` characters, or up to the last blank line in the chunk's second half; the next begins ``overlap`` before the end."""
    blank_lines = [m.start() + 2 for m in _BLANK_LINE.finditer(text)]  # where the text goes on after each
    end = 0
    while end < len(text):
        start = max(end - overlap, 0)
        end = start + size
        if end < len(text):
            last = bisect_right(blank_lines, end) - 1
            if last >= 0 and blank_lines[last] >= start + size // 2 + 2:
                end = blank_lines[last]
        yield start, min(end, len(text))


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, position, start_char, end_char, text of overlapping chunks that end at paragraphs where they can.

    Places count in the stripped document and enclose the chunk before it is stripped. Time is
    linear in the text: its blank lines are found once.
    """
    if not 0 <= overlap < size or overlap > size // 2 + 1:
        raise ValueError("overlap must be less than size and at most half of it, or chunks may not advance")

    def chunks(text: str) -> Iterator[tuple[int, int, int, str]]:
        body = text.strip(_SPACE)
        pieces = ((start, end, body[start:end].strip(_SPACE)) for start, end in chunk_spans(body, size, overlap))
        return ((k, *piece) for k, piece in enumerate(p for p in pieces if p[2]))

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    made = rows_of_texts(named, "body", chunks, "position int, start_char int, end_char int, text string", 3)
    return made.withColumnRenamed("id", id_col)


def join_units(units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each unit that isn't blank with start and end in the document that joins them by blank lines."""
    before = Window.partitionBy(id_col).orderBy("unit_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("markdown") + 2).over(before), F.lit(0))
    return units.where(F.btrim("markdown", F.lit(_SPACE)) != "").withColumn("unit_start", start.cast("int")).withColumn("unit_end", (F.col("unit_start") + F.length("markdown")).cast("int"))


def assign_units(chunks: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """chunks with source_unit_no: the unit with most in common, the nearer middle on ties, then the earlier; null without units."""
    units = spans.select(F.col(id_col).alias("_doc"), "unit_no", "unit_start", "unit_end")
    pairs = chunks.join(units, (F.col(id_col) == F.col("_doc")) & (F.col("unit_start") < F.col("end_char")) & (F.col("unit_end") > F.col("start_char")), "left")
    common = F.least("end_char", "unit_end") - F.greatest("start_char", "unit_start")
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    best = F.min_by("unit_no", F.struct(-common, F.abs(middle("start_char", "end_char") - middle("unit_start", "unit_end")), "unit_no"))
    return pairs.groupBy(*(F.col(c) for c in chunks.columns)).agg(best.alias("source_unit_no"))


def document_id_column(source: Column, doc_id: Column) -> Column:
    """The relative path under which a row of ``documents`` is filed."""
    return F.concat(source, F.lit("/doc_"), F.lpad(doc_id.cast("string"), 6, "0"), F.lit(".md"))

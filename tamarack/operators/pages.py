"""Pages: storing keys, search, grep, lookups, and the images on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import excerpt_score, page_score
from ..functions.text import match_snippet, page_body, page_key, sanitize_filename, squash
from .filters import Condition, where


def page_manifest(units: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, page_no, object_key, heading, char_count, is_synthetic, content_hash: units as numbered pages.

    Pages are numbered anew from 1; those of files other than PDF are synthetic.
    """
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no"))
    named = units.withColumn("page_no", number).join(documents.select("doc_id", "original_filename"), "doc_id")
    key = page_key(sanitize_filename(F.col("original_filename")), F.col("page_no"))
    return named.select(F.col("doc_id").alias("document_id"), "page_no", key.alias("object_key"), "heading", F.length(page_body(F.col("markdown"))).alias("char_count"), (~F.lower("original_filename").endswith(".pdf")).alias("is_synthetic"), F.sha2(page_body(F.col("markdown")), 256).alias("content_hash"))


def page_objects(units: DataFrame, documents: DataFrame) -> DataFrame:
    """prefix, object_key, data: the bodies of page_manifest's pages, for ``sources.packs`` or ``sources.objects.write_objects``.

    Documents whose names are made the same share a prefix; that with the largest id has it.
    """
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no"))
    safe = sanitize_filename(F.col("original_filename"))
    owners = documents.select("doc_id", safe.alias("_name")).groupBy("_name").agg(F.max("doc_id").alias("doc_id"))
    named = units.withColumn("page_no", number).join(owners, "doc_id")
    return named.select(F.concat(F.lit("documents/"), "_name", F.lit("/pages")).alias("prefix"), page_key(F.col("_name"), F.col("page_no")).alias("object_key"), F.encode(page_body(F.coalesce("markdown", F.lit(""))), "utf-8").alias("data"))


def load_pages(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pages with their bodies (object_key, body); blank headings of the manifest stay null."""
    return manifest.join(bodies, "object_key").select(manifest.columns + [F.coalesce("body", F.lit("")).alias("markdown")]).orderBy("document_id", "page_no")


def page_by_path(manifest: DataFrame, path: str) -> DataFrame:
    return manifest.where(F.lower("object_key") == path.lower())


def page_search(pages: DataFrame, documents: DataFrame, query: str, conditions: list[Condition] | None = None, limit: int = 10, document_ids: DataFrame | None = None) -> DataFrame:
    """Pages by weighted hits of the query; conditions must hold for the document and add their number to the score."""
    docs = documents if document_ids is None else documents.join(document_ids, "doc_id", "left_semi")
    docs = where(docs, conditions or []).select("doc_id", "original_filename", "relative_path")
    score, count, first = page_score(F.col("markdown"), F.col("heading"), query)
    scored = pages.withColumn("semantic_score", score).where("semantic_score > 0").withColumn("match_count", count).withColumn("text", match_snippet(F.col("markdown"), first))
    extra = len(conditions or [])
    hits = scored.join(docs, "doc_id").select("doc_id", "original_filename", "relative_path", "page_no", "heading", "text", F.round("semantic_score", 4).alias("semantic_score"), F.lit(extra).alias("metadata_score"), F.round(F.col("semantic_score") + extra, 4).alias("score"), "match_count", F.lit("page_content+metadata" if extra else "page_content").alias("matched_by"))
    return hits.orderBy(F.desc("score"), F.desc("match_count"), F.lower("original_filename"), "page_no", "doc_id").limit(max(limit, 1))


def _flagged(pattern: str) -> str:
    return f"(?mi){pattern}"


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_instr(text, F.lit(pattern))


def grep_pages(pages: DataFrame, pattern: str, limit: int = 8, path_col: str = "path", text_col: str = "markdown") -> DataFrame:
    """path, hits, snippet of the first pages by path that the pattern matches; the snippet begins with the match."""
    text, found = F.col(text_col), _flagged(pattern)
    snippet = squash(F.substring(text, _first(text, found), F.lit(220)))
    return pages.where(text.rlike(found)).select(path_col, F.regexp_count(text, F.lit(found)).alias("hits"), snippet.alias("snippet")).orderBy(path_col).limit(limit)


def grep_ranked(pages: DataFrame, pattern: str, limit: int = 8, path_col: str = "path", text_col: str = "markdown") -> DataFrame:
    """As grep_pages, with most hits first and some text before the match."""
    text, found = F.col(text_col), _flagged(pattern)
    at = _first(text, found)
    start = F.greatest(at - 40, F.lit(1))
    end = at + F.length(F.regexp_substr(text, F.lit(found))) + 180
    return pages.where(text.rlike(found)).select(path_col, F.regexp_count(text, F.lit(found)).alias("hits"), squash(F.substring(text, start, end - start)).alias("snippet")).orderBy(F.desc("hits"), path_col).limit(limit)


def grep_document(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = 5) -> DataFrame:
    """id, match_no, snippet of the first matches in each document: 40 characters before to 180 behind, squashed to 220."""
    found = _flagged(pattern)
    text = F.col(text_col)
    hits = docs.where(text.rlike(found)).withColumn("_m", F.slice(F.regexp_extract_all(text, F.lit(found), 0), 1, most)).withColumn("_g", F.split(text, found, most + 1))
    place = F.transform("_m", lambda m, i: F.struct((i + 1).alias("match_no"), F.aggregate(F.slice("_g", 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)).alias("gaps"), F.aggregate(F.slice("_m", 1, i), F.lit(0), lambda a, g: a + F.length(g)).alias("before"), F.length(m).alias("size")))
    each = hits.select(id_col, text_col, F.explode(place).alias("p"))
    start = F.col("p.gaps") + F.col("p.before")
    low = F.greatest(start - 40, F.lit(0))
    cut = F.substring(F.col(text_col), low + 1, start + F.col("p.size") + 180 - low)
    return each.select(id_col, F.col("p.match_no").alias("match_no"), F.substring(squash(cut), 1, 220).alias("snippet"))


def glob_pages(pages: DataFrame, directory: str, path_col: str = "path") -> DataFrame:
    """Range, number and first twenty of the page files below a directory."""
    inside = pages.where(F.col(path_col).startswith(directory.rstrip("/") + "/") & F.col(path_col).rlike(r"/page-\d+\.md$")).withColumn("_no", F.regexp_extract(path_col, r"page-(\d+)\.md$", 1).cast("int"))
    first = inside.orderBy(path_col).limit(20).agg(F.array_join(F.array_sort(F.collect_list(path_col)), "\n").alias("first_pages"))
    return inside.agg(F.count("*").alias("total"), F.min("_no").alias("first_page"), F.max("_no").alias("last_page")).crossJoin(first)  # one row each


def page_summary(manifest: DataFrame) -> DataFrame:
    """document_id, pages, last_page, synthetic_pages."""
    return manifest.groupBy("document_id").agg(F.count("*").alias("pages"), F.coalesce(F.max("page_no"), F.lit(0)).alias("last_page"), F.count_if("is_synthetic").alias("synthetic_pages"))


def relevant_pages(pages: DataFrame, excerpt: str, most: int = 2) -> DataFrame:
    """document_id, page_no of the pages of each document that an excerpt speaks of."""
    scored = pages.withColumn("_score", excerpt_score(F.col("markdown"), excerpt)).where("_score > 0")
    order = Window.partitionBy("document_id").orderBy(F.desc("_score"), "page_no")
    return scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).select("document_id", "page_no")


def images_by_page(pages: DataFrame, images: DataFrame, semantics: DataFrame) -> DataFrame:
    """document_id, page_no, heading, images: the known images of each page, in order."""
    known = images.join(semantics, "image_hash").select("document_id", "page_no", F.struct("image_index", "image_hash", "semantic_text").alias("image"))
    heads = pages.select("document_id", "page_no", "heading")
    return known.join(heads, ["document_id", "page_no"], "left").groupBy("document_id", "page_no").agg(F.min("heading").alias("heading"), F.array_sort(F.collect_list("image")).alias("images"))

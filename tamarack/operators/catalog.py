"""Listings, facets and summaries of the documents of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .filters import text_column


def facet_values(documents: DataFrame, fields: list[str], most: int = 10) -> DataFrame:
    """field, value, place: up to ``most`` distinct values of each metadata field, in the order of the first path that has them."""
    text = lambda f: F.col(text_column(f)) if text_column(f) in documents.columns else F.get_json_object("metadata_json", f"$.{f}")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields)))
    values = documents.select("relative_path", pairs.alias("p")).select("relative_path", "p.*").where("value is not null and value <> ''")
    first = values.groupBy("field", "value").agg(F.min("relative_path").alias("_path"))
    place = F.row_number().over(Window.partitionBy("field").orderBy("_path", "value"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("field", "value", "place")


def field_catalog(documents: DataFrame, fields: dict[str, str], most: int = 10) -> DataFrame:
    """field, description: what each field can be asked for; ranges are those of the facet values shown, not of all."""
    shown = facet_values(documents, list(fields), most)
    kinds = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    number = F.when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col("value").try_cast("double"))
    found = shown.groupBy("field").agg(F.min(number).alias("_low"), F.max(number).alias("_high"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda v: F.concat(F.lit("'"), v["value"], F.lit("'"))), ", ").alias("_values"))
    kind = kinds[F.col("field")]
    plain = lambda c: F.format_string("%.6f", c)
    short = lambda c: F.regexp_replace(F.regexp_replace(plain(F.col(c)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    told = F.when(kind == "boolean", F.lit("Values: true, false")).when(kind.isin("integer", "number") & F.col("_low").isNotNull(), F.concat(F.lit("Range: "), short("_low"), F.lit("-"), short("_high"))).otherwise(F.concat(F.lit("Values: "), F.col("_values")))
    return found.select("field", F.concat("field", F.lit(" ("), kind, F.lit(") "), told).alias("description"))


def library_text(documents: DataFrame) -> Column:
    """What a library search looks in."""
    return F.lower(F.concat_ws(" ", "original_filename", "relative_path", "absolute_path", "metadata_json"))


def list_documents(documents: DataFrame, query: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of the documents that contain the query, by path, each with the number of all."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be at least 1")
    found = documents.where(F.contains(library_text(documents), F.lit(query.lower()))) if query and query.strip() else documents
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("relative_path").offset((page - 1) * page_size).limit(page_size).crossJoin(F.broadcast(total))  # total is one row


def document_summaries(documents: DataFrame) -> DataFrame:
    """doc_id, original_filename, source_key, status: blanks fall back, a deleted document says so."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.coalesce(given("original_filename"), given("relative_path"), F.col("doc_id").cast("string"))
    return documents.select("doc_id", name.alias("original_filename"), F.coalesce(given("object_key"), given("relative_path"), name).alias("source_key"), F.when(F.coalesce("is_deleted", F.lit(False)), "deleted").otherwise(F.coalesce(given("upload_status"), F.lit("uploaded"))).alias("status"))


def index_status(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """One row: documents, deleted ones, chunks of live ones, whether there are metadata and embeddings."""
    docs = documents.agg(F.count_if(~F.col("is_deleted")).alias("documents"), F.count_if("is_deleted").alias("deleted"), F.coalesce(F.bool_or(F.coalesce("metadata_json", F.lit("{}")) != "{}"), F.lit(False)).alias("has_metadata"))
    live = chunks.join(documents.where("not is_deleted"), "doc_id", "left_semi").agg(F.count("*").alias("chunks"))
    some = F.lit(embeddings is not None and not embeddings.isEmpty())
    return docs.crossJoin(live).select("documents", "deleted", "chunks", "has_metadata", some.alias("has_embeddings"))  # one row each


def document_types(documents: DataFrame, type_col: str = "document_type") -> DataFrame:
    """One row: the sorted types observed; 'other' if there is none."""
    found = F.array_sort(F.collect_set(type_col))
    return documents.agg(F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("other").alias("types"))


def listing(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a table in the order that its listing has."""
    orders = {"documents": ["relative_path"], "schemas": [F.desc("created_at"), F.asc("name")], "collections": [F.lower("name"), F.asc("created_at")]}
    return rows.orderBy(*orders[kind])

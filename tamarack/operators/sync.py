"""What changes when a corpus is indexed again: differences, soft deletes, upserts.

All of these give new tables from old ones; ``sources.store`` writes them as snapshots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ids

UNIT_ATTRIBUTES = ["markdown", "content_hash", "heading", "source_locator", "images_json"]
PAGE_ATTRIBUTES = ["object_key", "heading", "char_count", "is_synthetic", "content_hash", "source_locator"]
#: What a failed parse says first.
PARSE_ERRORS = ("Error parsing ", "Unsupported file extension", "No such file:")


def deduplicated(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return changes.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with their keys."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(base.columns))


def replace_children(children: DataFrame, changes: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children with all of the given parents' replaced."""
    return children.join(parents.select(parent), parent, "left_anti").unionByName(changes.select(children.columns))


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of these documents."""
    return {name: t.join(ids.select(key), key, "left_anti") for name, t in tables.items()}


def mark_missing(documents: DataFrame, active_paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, those newly deleted): what isn't among the paths is deleted, nothing comes back."""
    present = documents.join(active_paths.select("relative_path").distinct().withColumn("_here", F.lit(True)), "relative_path", "left")
    marked = present.withColumn("_new", F.col("_here").isNull() & ~F.col("is_deleted"))
    columns = [c for c in documents.columns if c != "is_deleted"]
    return marked.select(*columns, (F.col("is_deleted") | F.col("_new")).alias("is_deleted")).select(documents.columns), marked.where("_new").select(documents.columns)


def _differs(attributes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in attributes))


def difference(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """keys, action: insert, update, keep or delete. Nulls are equal to each other."""
    both = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    action = F.when(F.col(f"o.{keys[0]}").isNull(), "insert").when(F.col(f"n.{keys[0]}").isNull(), "delete").when(_differs(attributes), "update").otherwise("keep")
    return both.select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys), action.alias("action"))


def sync(old: DataFrame, new: DataFrame, keys: list[str], owner: list[str], version: list[str] | None = None) -> DataFrame:
    """old with all rows of the owners in ``new`` replaced, within the same version only."""
    scope = [*owner, *(version or [])]
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new.select(old.columns))


def difference_counts(actions: DataFrame, by: list[str]) -> DataFrame:
    """by, upserted, untouched, deleted."""
    return actions.groupBy(*by).agg(F.count_if(F.col("action").isin("insert", "update")).alias("upserted"), F.count_if(F.col("action") == "keep").alias("untouched"), F.count_if(F.col("action") == "delete").alias("deleted"))


def upsert_images(images: DataFrame, seen: DataFrame) -> DataFrame:
    """images with new hashes added; of known ones only missing attributes are filled in, texts stay."""
    first = seen.groupBy("image_hash").agg(F.first("source_document_id", ignorenulls=True).alias("source_document_id"), F.max("mime_type").alias("mime_type"), F.max("width").alias("width"), F.max("height").alias("height"))
    both = images.alias("o").join(first.alias("n"), F.col("o.image_hash") == F.col("n.image_hash"), "full_outer")
    keep = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    return both.select(keep("image_hash"), keep("source_document_id"), keep("mime_type"), keep("width"), keep("height"), F.col("o.semantic_text").alias("semantic_text"))


def pending_images(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hashes that have no text yet, each once."""
    return wanted.select("image_hash").distinct().join(images.where("semantic_text is not null and semantic_text <> ''"), "image_hash", "left_anti")


def set_parse_state(documents: DataFrame, states: DataFrame) -> DataFrame:
    """documents with new parse states (doc_id, page_count, complete); complete never goes back."""
    s = states.select("doc_id", F.col("page_count").alias("_pages"), F.col("complete").alias("_complete"))
    both = documents.join(s, "doc_id", "left")
    return both.withColumn("page_count", F.coalesce("_pages", "page_count")).withColumn("parsed_is_complete", F.coalesce("parsed_is_complete", F.lit(False)) | F.coalesce("_complete", F.lit(False))).select(documents.columns)


def save_schema(schemas: DataFrame, schema: DataFrame) -> DataFrame:
    """schemas with one (corpus_id, name, schema_def, is_active, created_at) saved: its siblings become inactive if it is active; a known one keeps its time."""
    known = schemas.join(schema.select("corpus_id", "name"), ["corpus_id", "name"], "left_semi").select("corpus_id", "name", F.col("created_at").alias("_then"))
    new = schema.join(known, ["corpus_id", "name"], "left").withColumn("created_at", F.coalesce("_then", "created_at")).select(schemas.columns)
    taking = schema.where("is_active").select("corpus_id").distinct().withColumn("_taken", F.lit(True))
    others = schemas.join(schema.select("corpus_id", "name"), ["corpus_id", "name"], "left_anti").join(taking, "corpus_id", "left")
    return others.withColumn("is_active", F.col("is_active") & F.col("_taken").isNull()).select(schemas.columns).unionByName(new)


def stale(documents: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, stale: not indexed yet, or its file has another time (by more than a millionth) or size; a missing file isn't stale."""
    f = files.select("relative_path", F.col("file_mtime").alias("_mtime"), F.col("file_size").alias("_size"))
    unread = F.coalesce(F.btrim("content_hash"), F.lit("")) == ""
    changed = (F.abs(F.coalesce("file_mtime", F.lit(0.0)) - F.col("_mtime")) > 1e-6) | (F.coalesce("file_size", F.lit(-1)) != F.col("_size"))
    return documents.join(f, "relative_path", "left").select("doc_id", F.when(unread, True).when(F.col("_mtime").isNull(), False).otherwise(changed).alias("stale"))


def cache_probe(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """doc_id, result: 'hit' if all requested units (empty: all of a complete parse) are cached under the file's hash, 'partial' if some, else 'miss'.

    ``requests`` (doc_id, file_hash, unit_nos), ``cached`` (doc_id, content_hash, unit_nos, complete).
    """
    both = requests.join(cached.select("doc_id", F.col("content_hash").alias("_hash"), F.col("unit_nos").alias("_units"), "complete"), "doc_id", "left")
    same = F.col("file_hash") == F.col("_hash")
    lacking = F.array_except("unit_nos", F.coalesce("_units", F.array().cast("array<int>")))
    result = F.when(~F.coalesce(same, F.lit(False)), "miss").when(F.col("complete"), "hit").when(F.size("unit_nos") == 0, "miss").when(F.size(lacking) == 0, "hit").when(F.size(lacking) < F.size("unit_nos"), "partial").otherwise("miss")
    return both.select("doc_id", result.alias("result"))


def is_parse_error(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(text, F.lit("")).startswith(p) for p in PARSE_ERRORS))


def get_or_create_corpus(corpora: DataFrame, root: str, now: Column) -> DataFrame:
    """corpora with one for the root path; a known one stays as it is."""
    spark = corpora.sparkSession
    row = spark.range(1).select(ids.corpus_id(F.lit(root)).alias("corpus_id"), F.lit(root).alias("root_path"), now.cast("timestamp").alias("created_at"))
    return corpora.unionByName(row.join(corpora, "corpus_id", "left_anti"))


def stub(known: DataFrame, key: DataFrame, corpus: str, relative_path: str, absolute_path: str, original_filename: str, object_key: str | None, size: int) -> DataFrame:
    """The row of a document before it is parsed. What is known of it stays, but for the upload's name, key, size and status; it is active again."""
    given = {"corpus_id": F.lit(corpus), "relative_path": F.lit(relative_path), "absolute_path": F.lit(absolute_path), "original_filename": F.lit(original_filename), "object_key": F.lit(object_key).cast("string"), "file_size": F.lit(size).cast("bigint"), "upload_status": F.lit("uploaded"), "is_deleted": F.lit(False)}
    fresh = {"content": F.lit(""), "metadata_json": F.lit("{}"), "content_hash": F.lit(""), "parsed_is_complete": F.lit(False), "file_mtime": F.lit(0.0)}
    both = key.join(known, "doc_id", "left")
    return both.select(*(given[c].alias(c) if c in given else F.coalesce(c, fresh[c]).alias(c) if c in fresh else F.col(c) for c in known.columns))


def set_attributes(documents: DataFrame, **values) -> DataFrame:
    """documents with these columns set; a value is a column or a literal."""
    settable = {"metadata_json", "relative_path", "absolute_path", "upload_status", "is_deleted"}
    if unknown := set(values) - settable:
        raise ValueError(f"can't set {sorted(unknown)}")
    return documents.withColumns({c: (v if isinstance(v, Column) else F.lit(v)).cast(documents.schema[c].dataType) for c, v in values.items()})

"""Scopes and collections of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class ScopeError(ValueError):
    """The collection doesn't exist or is deleted."""


def resolve_scope(documents: DataFrame, members: DataFrame, collections: DataFrame, collection_id: str | None = None, document_ids: DataFrame | None = None) -> DataFrame:
    """doc_id of the live documents in the collection or the list; all live ones if neither is given."""
    live = documents.where("not is_deleted")
    if collection_id is None and document_ids is None:
        return live.select("doc_id")
    parts = []
    if collection_id is not None:
        if collections.where((F.col("collection_id") == collection_id) & ~F.col("is_deleted")).isEmpty():
            raise ScopeError(f"no collection {collection_id}")
        parts.append(members.where(F.col("collection_id") == collection_id).select("doc_id"))
    if document_ids is not None:
        parts.append(document_ids.select("doc_id"))
    wanted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return live.join(wanted, "doc_id", "left_semi").select("doc_id")


def collection_documents(documents: DataFrame, members: DataFrame, collection_id: str) -> DataFrame:
    return documents.where("not is_deleted").join(members.where(F.col("collection_id") == collection_id).select("doc_id").distinct(), "doc_id").orderBy("relative_path")


def attach(members: DataFrame, collection_id: str, document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with the documents added, those newly added); blanks and repeats are ignored."""
    asked = document_ids.where("doc_id is not null").select(F.lit(collection_id).alias("collection_id"), "doc_id").distinct()
    new = asked.join(members, ["collection_id", "doc_id"], "left_anti")
    return members.unionByName(new), new


def detach(members: DataFrame, collection_id: str, document_ids: DataFrame | None = None) -> DataFrame:
    """members without these documents of the collection, or without any of it."""
    of = members.where(F.col("collection_id") == collection_id)
    gone = of if document_ids is None else of.join(document_ids, "doc_id", "left_semi")
    return members.join(gone.select("collection_id", "doc_id"), ["collection_id", "doc_id"], "left_anti")


def change_collection(collections: DataFrame, collection_id: str, now, name: str | None = None, deleted: bool | None = None) -> DataFrame:
    """collections with one renamed or (un)deleted, and its time of change."""
    this = F.col("collection_id") == collection_id
    out = collections.withColumn("updated_at", F.when(this, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")))
    if name is not None:
        out = out.withColumn("name", F.when(this, name).otherwise(F.col("name")))
    return out if deleted is None else out.withColumn("is_deleted", F.when(this, F.lit(deleted)).otherwise(F.col("is_deleted")))

"""Identities: digests of what names a thing, so that they never need a lookup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _digest(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha1(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")))


def corpus_id(root_path: Column) -> Column:
    return _digest("corpus_", root_path)


def document_id(corpus: Column, relative_path: Column) -> Column:
    return _digest("doc_", corpus, relative_path)


def chunk_id(document: Column, position: Column, start: Column, end: Column) -> Column:
    return _digest("chunk_", document, position, start, end)


def schema_id(corpus: Column, name: Column) -> Column:
    return _digest("schema_", corpus, name)


def collection_id(name: Column, created_at: Column) -> Column:
    """``created_at`` is given, so that the id can be told again."""
    return _digest("collection_", name, created_at)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)

"""The engine: indexing a folder into snapshots, and searching them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids
from ..operators import catalog, chunking, events, inverted, metadata, pages, scope, search, sync, units
from ..operators.filters import parse_filters
from ..sources import files
from ..sources.store import KEYS, SnapshotStore

PARSER_VERSION = "1"
#: Segments of a search index, above which they are made one.
MOST_SEGMENTS = 8


@dataclass(frozen=True)
class IndexResult:
    indexed: int
    skipped: int
    failed: int
    deleted: int
    chunks: int
    embeddings: int


class Engine:
    """One corpus in a snapshot store. ``embed`` and ``parsers`` are the caller's models."""

    def __init__(self, spark: SparkSession, store: str, root: str, parsers: dict[str, Callable[[bytes], str]] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None):
        self.spark, self.store, self.root = spark, SnapshotStore(spark, store), root
        self.parsers, self.embed = parsers, embed
        self.corpus = spark.range(1).select(ids.corpus_id(F.lit(root))).first()[0]

    def _mine(self, name: str) -> DataFrame:
        table = self.store.read(name)
        return table.where(F.col("corpus_id") == self.corpus) if "corpus_id" in table.columns else table

    @property
    def documents(self) -> DataFrame:
        return self._mine("documents")

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    def index(self) -> IndexResult:
        """Bring the snapshots up to date with the folder; files whose bytes are known are left as they are."""
        return self._index(files.scan(self.spark, self.root), whole=True)

    def index_files(self, found: DataFrame, progress: tuple[str, int] | None = None) -> IndexResult:
        """Index some files, rows of ``files.scan``; documents of others stay as they are.

        ``progress`` (stream, batch) is committed with them: a batch that is given again does nothing.
        """
        if progress and not self.store.read("stream_batches").where((F.col("stream") == progress[0]) & (F.col("batch") >= progress[1])).isEmpty():
            return IndexResult(0, 0, 0, 0, 0, 0)
        return self._index(found, whole=False, progress=progress)

    def _index(self, found: DataFrame, whole: bool, progress: tuple[str, int] | None = None) -> IndexResult:
        old = self.documents
        live = old.where("not is_deleted").select("relative_path", F.col("content_hash").alias("file_hash"))
        changed = found.join(live, ["relative_path", "file_hash"], "left_anti")
        parsed = files.parse(changed, self.parsers).join(found.select("relative_path", "path", "file_size", "file_mtime"), "relative_path")
        good = parsed.where("error is null").withColumn("doc_id", ids.document_id(F.lit(self.corpus), F.col("relative_path"))).cache()
        meta = metadata.as_json(metadata.base_metadata(good))
        rows = good.join(meta, "relative_path").select(
            "doc_id", F.lit(self.corpus).alias("corpus_id"), "relative_path", F.col("path").alias("absolute_path"), F.regexp_replace("relative_path", "^.*/", "").alias("original_filename"), F.lit(None).cast("string").alias("object_key"), "content", "metadata_json", "file_mtime", "file_size",
            F.col("file_hash").alias("content_hash"), F.lit(None).cast("int").alias("page_count"), F.lit(True).alias("parsed_is_complete"), F.lit("uploaded").alias("upload_status"), F.lit(False).alias("is_deleted"), F.current_timestamp().alias("last_indexed_at"),
        )
        made = units.whole_units(good, "doc_id", "content").withColumn("images_json", F.lit("[]")).withColumn("parser_version", F.lit(PARSER_VERSION)).cache()
        spans = chunking.join_units(made)
        joined = units.rebuilt_documents(made)
        pieces = chunking.assign_units(chunking.chunk_documents(joined, "doc_id", "markdown"), spans)
        pieces = pieces.withColumn("chunk_id", ids.chunk_id(F.col("doc_id"), F.col("position"), F.col("start_char"), F.col("end_char"))).cache()
        numbered = pages.page_manifest(made, rows)

        # only what has changed is written: the documents that are new, different or gone, and what hangs on them
        active = (sync.mark_missing(old, found.select("relative_path"))[1] if whole else old.limit(0)).cache()
        gone = active.count()
        mine = good.select("doc_id").cache()
        changes = {
            "documents": (mine.unionByName(active.select("doc_id")), rows.unionByName(active.withColumn("is_deleted", F.lit(True)).join(mine, "doc_id", "left_anti"), allowMissingColumns=True)),
            "chunks": (mine, pieces),
            "parsed_units": (mine, made),
            "document_pages": (mine.withColumnRenamed("doc_id", "document_id"), numbered),
        }
        n_embedded = 0
        if self.embed:
            fresh = metadata.embed_texts(pieces.select("chunk_id", "doc_id", "position", "text"), self.embed).drop("text")
            changes["chunk_embeddings"] = (mine, fresh)
            n_embedded = pieces.count()
        counts = IndexResult(good.count(), found.count() - changed.count(), parsed.where("error is not null").count(), gone, pieces.count(), n_embedded)
        corpora = self.store.read("corpora")
        known = not corpora.where(F.col("corpus_id") == self.corpus).isEmpty()
        tables = {} if known else {"corpora": sync.get_or_create_corpus(corpora, self.root, F.current_timestamp())}
        if counts.indexed:
            paths = rows.select("doc_id", "relative_path")
            tables |= self._added({"chunks": pieces.join(paths, "doc_id"), "pages": self._as_pages(made).join(paths, "doc_id")}, mine)
        if progress:
            batches = self.store.read("stream_batches")
            tables["stream_batches"] = batches.where(F.col("stream") != progress[0]).unionByName(self.spark.createDataFrame([progress], batches.schema))
        self.store.commit(changes, **tables)
        for df in (good, made, pieces, active, mine):
            df.unpersist()
        if self.store.read("search_segments").count() > 2 * MOST_SEGMENTS:
            self.compact_search()
        return counts

    @staticmethod
    def _as_pages(made: DataFrame) -> DataFrame:
        return made.select("doc_id", F.col("unit_no").alias("position"), "heading", F.col("markdown").alias("text"))

    def _added(self, rows: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
        """The tables of segments with a new one for each kind; documents that it holds are removed from older ones."""
        segments, removed = self.store.read("search_segments"), self.store.read("search_removed")
        for kind, new in rows.items():
            last = segments.where(F.col("kind") == kind).agg(F.max("number")).first()[0]
            number = 0 if last is None else last + 1
            made = inverted.write_segment(new, f"{self.store.root}/search/{uuid.uuid4().hex}", number)
            segments = segments.unionByName(self.spark.createDataFrame([(kind, made.path, number)], segments.schema))
            if number:
                removed = removed.unionByName(doc_ids.select(F.lit(kind).alias("kind"), "doc_id", F.lit(number - 1).alias("up_to")))
        return {"search_segments": segments, "search_removed": removed}

    def compact_search(self) -> None:
        """Make one segment of each kind from the current chunks and pages."""
        paths = self.store.read("documents").select("doc_id", "relative_path")
        rows = {"chunks": self.chunks.join(paths, "doc_id"), "pages": self._as_pages(self.store.read("parsed_units")).join(paths, "doc_id")}
        made = [(kind, inverted.write_segment(new, f"{self.store.root}/search/{uuid.uuid4().hex}").path, 0) for kind, new in rows.items()]
        self.store.commit(search_segments=self.spark.createDataFrame(made, self.store.read("search_segments").schema), search_removed=self.store.read("search_removed").limit(0))

    def _index_of(self, kind: str) -> tuple[list[inverted.Segment], DataFrame]:
        rows = self.store.read("search_segments").where(F.col("kind") == kind).collect()  # a handful: segments are made one
        return [inverted.Segment(r.path, r.number) for r in rows], self.store.read("search_removed").where(F.col("kind") == kind)

    def reconcile(self) -> IndexResult:
        """What only a listing of the folder tells: files that are gone, and known ones that have changed.

        Deletions are an anti-join of the listing, which opens no file; of the others only changed ones are read.
        """
        listed = files.listing(self.spark, self.root)
        live = self.documents.where("not is_deleted")
        gone = sync.mark_missing(live, listed.select("relative_path"))[1].select("doc_id").cache()
        n = gone.count()
        if n:
            self.set_attributes(gone, is_deleted=True)
        gone.unpersist()
        changed = live.join(sync.stale(live, listed.select("relative_path", "file_mtime", "file_size")).where("stale"), "doc_id", "left_semi").select("relative_path")
        paths = [r.path for r in listed.join(changed, "relative_path", "left_semi").select("path").collect()]  # of what has changed since the last time
        done = self.index_files(files.scan_paths(self.spark, self.root, paths)) if paths else IndexResult(0, 0, 0, 0, 0, 0)
        return replace(done, deleted=n)

    def index_if_stale(self) -> IndexResult | None:
        """Index again if any document's file has changed since."""
        found = files.listing(self.spark, self.root).select("relative_path", "file_mtime", "file_size")
        changed = sync.stale(self.documents.where("not is_deleted"), found).where("stale")
        new = found.join(self.documents.where("not is_deleted"), "relative_path", "left_anti")
        return None if changed.isEmpty() and new.isEmpty() else self.index()

    def search(self, query: str, filters: str | None = None, limit: int = 10, document_ids: DataFrame | None = None, allowed_fields: list[str] | None = None, refresh: bool = True) -> DataFrame:
        """Ranked documents by text and metadata; vectors stand in for keywords where there are any."""
        if refresh:
            self.index_if_stale()
        semantic, vectors = None, self.store.read("chunk_embeddings")
        if self.embed and not vectors.isEmpty():
            semantic = search.chunk_vector_search(vectors, self.chunks, self.documents, self.embed([query])[0], search.OVERFETCH * max(limit, 1), document_ids)
        segments, removed = self._index_of("chunks")
        keywords = inverted.indexed_keyword_search(segments, self.documents, query, search.OVERFETCH * max(limit, 1), document_ids, removed).rows
        return search.hybrid_search(self.chunks, self.documents, query, parse_filters(filters, allowed_fields), limit, document_ids, semantic, keywords=keywords)

    def search_pages(self, query: str, filters: str | None = None, limit: int = 10, document_ids: DataFrame | None = None) -> DataFrame:
        segments, removed = self._index_of("pages")
        return inverted.indexed_page_search(segments, search.active(self.documents), query, parse_filters(filters), limit, document_ids, removed).rows

    def list_documents(self, query: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
        return catalog.list_documents(self.documents, query, page, page_size)

    def facets(self, fields: list[str], most: int = 10) -> DataFrame:
        return catalog.facet_values(search.active(self.documents), fields, most)

    def status(self) -> DataFrame:
        return catalog.index_status(self.documents, self.chunks, self.store.read("chunk_embeddings"))

    def folder_status(self) -> DataFrame:
        """One row: indexed, corpus_id, document_count, schema_name, has_metadata (the schema has a profile), has_embeddings, schema_fields."""
        known = self.store.read("corpora").where(F.col("corpus_id") == self.corpus)
        counts = self.documents.where("not is_deleted").agg(F.count("*").alias("document_count"))
        embedded = self.store.read("chunk_embeddings").join(self.documents, "doc_id", "left_semi").limit(1).agg((F.count("*") > 0).alias("has_embeddings"))
        fields = F.from_json(F.get_json_object("schema_def", "$.fields"), "array<struct<name:string>>")
        named = F.transform(F.filter(F.coalesce(fields, F.array().cast("array<struct<name:string>>")), lambda f: f["name"].isNotNull()), lambda f: f["name"])
        active = self.schema().agg(F.max_by(F.struct("name", F.get_json_object("schema_def", "$.metadata_profile").isNotNull().alias("profiled"), named.alias("fields")), "created_at").alias("s"))
        status = known.agg((F.count("*") > 0).alias("indexed")).crossJoin(counts).crossJoin(embedded).crossJoin(active)  # one row each
        return status.select("indexed", F.lit(self.corpus).alias("corpus_id"), "document_count", F.col("s.name").alias("schema_name"), F.coalesce("s.profiled", F.lit(False)).alias("has_metadata"), "has_embeddings", F.coalesce("s.fields", F.array().cast("array<string>")).alias("schema_fields"))

    def append_events(self, new: DataFrame) -> None:
        """Add events (session_id, event_id, ts, type, data) to the sessions' log; known ones (by id) stay as they are."""
        known = self.store.read("session_events").join(new.select("session_id").distinct(), "session_id", "left_semi")
        fresh = new.select(known.columns).join(known, ["session_id", "event_id"], "left_anti").dropDuplicates(["session_id", "event_id"]).select(known.columns)
        self.store.commit({"session_events": (new.select("session_id"), known.unionByName(fresh))})

    def sessions(self) -> DataFrame:
        return events.final_states(self.store.read("session_events"))

    def session_events(self, session_id: int, after: int = 0) -> DataFrame:
        """The wire frames of a session behind a place in its sequence: what a client that comes back has missed."""
        mine = self.store.read("session_events").where(F.col("session_id") == session_id)
        return events.sse_frames(mine).where(F.col("sequence") > after).orderBy("sequence")

    def prune_sessions(self, now, minutes: int = events.RETENTION_MINUTES) -> None:
        """Forget the sessions that are over and idle for longer."""
        log = self.store.read("session_events")
        gone = log.select("session_id").distinct().join(events.retained(log, F.lit(now).cast("timestamp"), minutes), "session_id", "left_anti")
        self.store.commit({"session_events": (gone, log.limit(0))})

    def resolve_scope(self, collection_id: str | None = None, document_ids: DataFrame | None = None) -> DataFrame:
        return scope.resolve_scope(self.documents, self.store.read("collection_documents"), self.store.read("collections"), collection_id, document_ids)

    def schema(self) -> DataFrame:
        """The active schema of the corpus."""
        return self._mine("schemas").where("is_active")

    def save_schema(self, name: str, schema_def: str, active: bool = True, now: str | None = None) -> None:
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        row = self.spark.range(1).select(ids.schema_id(F.lit(self.corpus), F.lit(name)).alias("schema_id"), F.lit(self.corpus).alias("corpus_id"), F.lit(name).alias("name"), F.lit(schema_def).alias("schema_def"), F.lit(active).alias("is_active"), at.alias("created_at"))
        self.store.commit(schemas=sync.save_schema(self.store.read("schemas"), row))

    def create_collection(self, name: str, now) -> str:
        row = self.spark.range(1).select(ids.collection_id(F.lit(name), F.lit(str(now))).alias("collection_id"), F.lit(name).alias("name"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"), F.lit(False).alias("is_deleted"))
        self.store.commit(collections=self.store.read("collections").unionByName(row))
        return row.first()["collection_id"]

    def rename_collection(self, collection_id: str, name: str, now) -> None:
        self.store.commit(collections=scope.change_collection(self.store.read("collections"), collection_id, now, name=name))

    def delete_collection(self, collection_id: str, now) -> None:
        self.store.commit(collections=scope.change_collection(self.store.read("collections"), collection_id, now, deleted=True))

    def attach(self, collection_id: str, document_ids: DataFrame) -> None:
        """Put documents into a collection; those of their rows that are there already stay."""
        known = self.store.read("collection_documents").join(document_ids.select("doc_id"), "doc_id", "left_semi")
        self.store.commit({"collection_documents": (document_ids, scope.attach(known, collection_id, document_ids)[0])})

    def detach(self, collection_id: str, document_ids: DataFrame) -> None:
        known = self.store.read("collection_documents").join(document_ids.select("doc_id"), "doc_id", "left_semi")
        self.store.commit({"collection_documents": (document_ids, scope.detach(known, collection_id))})

    def upsert_stub(self, relative_path: str, original_filename: str, object_key: str | None = None, size: int = 0) -> str:
        """A document that is uploaded but not parsed yet; a known one keeps its content."""
        key = self.spark.range(1).select(ids.document_id(F.lit(self.corpus), F.lit(relative_path)).alias("doc_id"))
        known = self.store.read("documents").join(key, "doc_id", "left_semi")
        row = sync.stub(known, key, self.corpus, relative_path, f"{self.root}/{relative_path}", original_filename, object_key, size)
        self.store.commit({"documents": (key, row)})
        return key.first()["doc_id"]

    def set_attributes(self, document_ids: DataFrame, **values) -> None:
        """Set columns of documents: metadata_json, relative_path, absolute_path, upload_status or is_deleted."""
        hit = self.store.read("documents").join(document_ids.select("doc_id"), "doc_id", "left_semi")
        self.store.commit({"documents": (document_ids, sync.set_attributes(hit, **values))})

    def delete(self, document_ids: DataFrame, physically: bool = False) -> None:
        """Mark documents as deleted, or remove them with all that hangs on them."""
        if physically:
            tables = ["documents", "chunks", "parsed_units", "document_pages", "collection_documents", "chunk_embeddings"]
            named = {n: document_ids.select(F.col("doc_id").alias(KEYS[n])) for n in tables}
            self.store.commit({n: (keys, self.store.read(n).limit(0)) for n, keys in named.items()})
        else:
            self.set_attributes(document_ids, is_deleted=True)

"""Tables as immutable Parquet snapshots with a pointer to the current one.

A write makes a new snapshot of every table that changes and moves the pointer
last, so readers see all of it or nothing, and no path is overwritten that a plan
still reads. Of two writers that begin at the same commit the second fails: a commit's
number belongs to who creates its file first, which file systems decide.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.filters import shred, shredded_names

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: Fields of metadata that documents are stored with as typed columns; filters on them reach the scan.
SHREDDED = ("filename", "relative_path", "extension", "document_type", "file_size", "file_mtime", "mentions_currency", "mentions_dates")
_TYPED = {n: T.VariantType() if n == "meta" else _D if n.endswith("_number") else _S for n in shredded_names(SHREDDED)}

#: The tables of a corpus.
SCHEMAS = {
    "corpora": _table(corpus_id=_S, root_path=_S, created_at=_TS),
    "documents": _table(doc_id=_S, corpus_id=_S, relative_path=_S, absolute_path=_S, original_filename=_S, object_key=_S, content=_S, metadata_json=_S, file_mtime=_D, file_size=_L, content_hash=_S, page_count=_I, parsed_is_complete=_B, upload_status=_S, is_deleted=_B, last_indexed_at=_TS, **_TYPED),
    "chunks": _table(chunk_id=_S, doc_id=_S, position=_I, start_char=_I, end_char=_I, source_unit_no=_I, text=_S),
    "parsed_units": _table(doc_id=_S, unit_no=_I, markdown=_S, content_hash=_S, heading=_S, source_locator=_S, images_json=_S, parser_version=_S),
    "document_pages": _table(document_id=_S, page_no=_I, object_key=_S, heading=_S, char_count=_I, is_synthetic=_B, content_hash=_S),
    "image_semantics": _table(image_hash=_S, source_document_id=_S, mime_type=_S, width=_I, height=_I, semantic_text=_S),
    "schemas": _table(schema_id=_S, corpus_id=_S, name=_S, schema_def=_S, is_active=_B, created_at=_TS),
    "collections": _table(collection_id=_S, name=_S, created_at=_TS, updated_at=_TS, is_deleted=_B),
    "collection_documents": _table(collection_id=_S, doc_id=_S),
    "chunk_embeddings": _table(chunk_id=_S, doc_id=_S, position=_I, embedding=T.ArrayType(T.FloatType())),
    "session_events": _table(session_id=_L, event_id=_L, ts=_TS, type=_S, data=_S),
    "search_segments": _table(kind=_S, path=_S, number=_I),
    "search_removed": _table(kind=_S, doc_id=_S, up_to=_I),
    "object_packs": _table(path=_S, number=_I),
    "stream_batches": _table(stream=_S, batch=_L),
}


#: The column by whose hash a table's rows are dealt to buckets; other tables are small and have one.
KEYS = {"documents": "doc_id", "chunks": "doc_id", "parsed_units": "doc_id", "document_pages": "document_id", "collection_documents": "doc_id", "chunk_embeddings": "doc_id", "session_events": "session_id", "object_packs": "path"}
BUCKETS = 256
#: Folder of the files by which writers take the numbers of commits.
CLAIMS = "_claims"


class SnapshotStore:
    """The current snapshots of named tables below a root that Spark can write to.

    A large table is ``buckets`` folders by the hash of its key; a change of some
    documents rewrites only the buckets that they are in.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        folder = self._path(f"{self.root}/_current")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def current(self) -> tuple[int, dict[str, dict[str, str]]]:
        """(number of the commit, table -> bucket -> folder)."""
        names = self._pointers()
        if not names:
            return -1, {}
        return int(names[-1].split(".")[0]), self._contents(names[-1])

    def _contents(self, pointer: str) -> dict[str, dict[str, str]]:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/_current/{pointer}", wholetext=True).collect()))

    def _of(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        return self._of(name, sorted(self.current()[1].get(name, {}).values()))

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _written(self, name: str, df: DataFrame) -> dict[str, str]:
        """bucket -> folder of the rows, written."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        if name == "documents":
            df = shred(df, SHREDDED)
        rows = df.select([df[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
        if name not in KEYS:
            rows.write.parquet(path)
            return {"0": path}
        # partitions of one bucket each, large buckets in several
        rows.withColumn("bucket", self._bucket(KEYS[name])).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        return {f.removeprefix("bucket="): f"{path}/{f}" for f in folders if f.startswith("bucket=")}

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame]] | None = None, since: int | None = None, **tables: DataFrame) -> None:
        """Make new contents current, all at once: of whole ``tables``, and in ``changes`` of the rows that some keys have.

        A change is (keys, rows): rows take the place of all rows with these keys, a column of
        the table's key name; buckets without any of them stay as they are. Fails if another writer
        has committed since this one began, or since the commit with the number ``since``.
        """
        number, now = self.current()
        if since is not None and number != since:
            raise OSError("another writer was first")
        for name, df in tables.items():
            now[name] = self._written(name, df)
        for name, (keys, rows) in (changes or {}).items():
            key, old = KEYS[name], now.get(name, {})
            keys = keys.select(key).distinct()
            # at most as many numbers as there are buckets
            touched = {str(r[0]) for r in keys.select(self._bucket(key)).unionByName(rows.select(self._bucket(key))).distinct().collect()}
            rest = self._of(name, [old[b] for b in sorted(touched & old.keys())]).join(keys, key, "left_anti")
            now[name] = {b: f for b, f in old.items() if b not in touched} | self._written(name, rest.unionByName(rows, allowMissingColumns=True))
        # written under another name first: a rename is all or nothing
        draft = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._claimed(number + 1):
            self._fs.delete(draft, False)
            raise OSError("another writer was first")
        if not self._fs.rename(draft, self._path(f"{self.root}/_current/{number + 1:010d}.json")):
            raise OSError("the commit could not be published")

    def _claimed(self, number: int) -> bool:
        """Whether this writer may publish a commit: of all that try one creates the file that says so."""
        folder = self._path(f"{self.root}/{CLAIMS}")
        self._fs.mkdirs(folder)
        self._fs.mkdirs(self._path(f"{self.root}/_current"))
        place = self._path(f"{self.root}/{CLAIMS}/{number:010d}")
        try:
            if self._fs.getScheme() == "file":  # there Hadoop's create looks first and creates then
                nio = self.spark._jvm.java.nio.file
                nio.Files.createFile(nio.Paths.get(self._fs.makeQualified(place).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)), self.spark.sparkContext._gateway.new_array(nio.attribute.FileAttribute, 0))
            else:
                self._fs.create(place, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def release(self, number: int) -> bool:
        """Give back a commit's number that a writer took and then died before publishing it."""
        if self._fs.exists(self._path(f"{self.root}/_current/{number:010d}.json")):
            return False
        return self._fs.delete(self._path(f"{self.root}/{CLAIMS}/{number:010d}"), False)

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600.0) -> int:
        """Remove what none of the last ``keep`` commits names and was written longer ago; how many folders went.

        Readers of older commits fail then, so both should exceed what a query may take.
        """
        names = self._pointers()
        named: set[str] = set()
        for name in names[-keep:]:
            tables = self._contents(name)
            named |= {f for buckets in tables.values() for f in buckets.values()}
            for kind in ("search_segments", "object_packs"):
                named |= {r.path for r in self._of(kind, sorted(tables.get(kind, {}).values())).select("path").collect()}  # a handful
        gone, now = 0, time.time()
        for table in [*SCHEMAS, "search", "objects"]:
            top = self._path(f"{self.root}/{table}")
            for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
                path = f"{self.root}/{table}/{s.getPath().getName()}"
                if now - s.getModificationTime() / 1000 >= older_than and not any(f == path or f.startswith(f"{path}/") for f in named):
                    gone += self._fs.delete(self._path(path), True)
        for name in names[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_current/{name}"), False)
        return gone

"""Objects: files below a root, by keys like ``documents/name/pages/page-0001.md``.

``write_objects`` is a Python data source. Its tasks stage files where no reader looks,
with a list of their prefixes beside them; a commit first writes down which tasks' files
it publishes, then moves all old files of their prefixes away and the staged ones in,
folder by folder; an abort removes what was staged. A commit that was cut off after it
was written down is finished by ``recover``, and what was staged without one is removed
by it. Lists are read some prefixes at a time, so the driver holds few. Readers list by
tasks (``files.found``), and listings never open a file.

Keys are relative and stay below the root: absolute ones, ``..``, empty parts and names
that begin with a dot or an underscore (which Spark's readers don't see) are refused,
and the write fails. Rows are dealt by ranges of prefix and key, so a large prefix is
written by many tasks and a key by one; a prefix without rows is left as it is. Roots are those that pyarrow knows (local and mounted folders, HDFS,
S3); where a folder can't be moved, its files are, one by one.
"""

from __future__ import annotations

import io
import itertools
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import contents, found, relative_to

STAGING, MARK, AWAY, LIST = ".staging", "COMMIT", "AWAY", "prefixes"
#: Folders that are moved at once, and that are read of the lists at once.
MOVERS, HELD = 16, 4096
#: Age, in seconds, at which files that were staged without a commit are given up.
ABANDONED = 24 * 3600.0


class KeyRefused(ValueError):
    """The key isn't one of a file below the root."""


def checked(key: str) -> str:
    parts = (key or "").replace("\\", "/").split("/")
    if not key or key[0] in "/\\" or any(not p or p[0] in "._" for p in parts):
        raise KeyRefused(f"not a key below the root: {key!r}")
    return "/".join(parts)


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path of the root in it)."""
    fs, path = pafs.FileSystem.from_uri(root)
    return fs, path.rstrip("/")


def _kind(fs: pafs.FileSystem, path: str) -> pafs.FileType:
    return fs.get_file_info(path).type


def _files(fs: pafs.FileSystem, path: str) -> list[str]:
    return [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True)) if f.type == pafs.FileType.File]


def _move(fs: pafs.FileSystem, old: str, new: str) -> None:
    fs.create_dir(new.rpartition("/")[0], recursive=True)
    if _kind(fs, new) == pafs.FileType.NotFound:
        try:
            fs.move(old, new)
            return
        except (OSError, pa.ArrowNotImplementedError):
            if _kind(fs, old) != pafs.FileType.Directory:
                raise
    made = set()
    for f in _files(fs, old):
        target = new + f.removeprefix(old)
        folder = target.rpartition("/")[0]
        if folder not in made:
            fs.create_dir(folder, recursive=True)
            made.add(folder)
        fs.move(f, target)
    fs.delete_dir(old)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    prefixes: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.name = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = opened(self.root)
        # each attempt of a task has a folder of its own: of two, one is committed
        folder, prefixes, keys = f"{root}/{STAGING}/{self.name}/{uuid.uuid4().hex}", {}, set()
        made = set()
        for batch in iterator:
            for prefix, key, data in zip(*(batch.column(c).to_pylist() for c in ("prefix", "object_key", "data")), strict=True):
                prefix, key = checked(prefix), checked(key)
                if not key.startswith(f"{prefix}/") or key in keys:
                    raise KeyRefused(f"{key!r} is not below {prefix!r}, or comes twice")
                keys.add(key)
                number = prefixes.setdefault(prefix, len(prefixes))
                path = f"{folder}/{number}/{key.removeprefix(prefix + '/')}"
                if (parent := path.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(path) as out:
                    out.write(data or b"")
        if prefixes:
            with fs.open_output_stream(f"{folder}/{LIST}") as out:
                for prefix in prefixes:
                    out.write(json.dumps(prefix).encode() + b"\n")
        return Staged(folder.removeprefix(root + "/"), len(prefixes))

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.root)
        place = f"{root}/{STAGING}/{self.name}"
        folders = [m.folder for m in messages if m and m.prefixes]
        if folders:
            with fs.open_output_stream(f"{place}/{MARK}.draft") as out:
                out.write(json.dumps({"folders": folders}).encode())
            fs.move(f"{place}/{MARK}.draft", f"{place}/{MARK}")
            _publish(fs, root, place)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.root)
        if _kind(fs, f"{root}/{STAGING}/{self.name}") == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{STAGING}/{self.name}")


def _publish(fs: pafs.FileSystem, root: str, place: str) -> None:
    """Do what a commit has written down: all old files away, then the staged ones in; what is done already is seen by its files being gone."""
    with fs.open_input_stream(f"{place}/{MARK}") as f:
        folders = json.loads(f.read())["folders"]

    def staged() -> Iterator[tuple[str, str]]:
        for folder in folders:
            with io.TextIOWrapper(fs.open_input_stream(f"{root}/{folder}/{LIST}"), "utf-8") as f:
                for i, line in enumerate(f):
                    yield f"{root}/{folder}/{i}", json.loads(line)

    def away(prefix: str, _: list[str]) -> None:
        if _kind(fs, f"{root}/{prefix}") == pafs.FileType.Directory:
            _move(fs, f"{root}/{prefix}", f"{place}/old/{prefix}")

    def into(prefix: str, parts: list[str]) -> None:
        for s in parts:
            if _kind(fs, s) == pafs.FileType.Directory:
                _move(fs, s, f"{root}/{prefix}")

    def every(work: Callable[[str, list[str]], None], pool: ThreadPoolExecutor) -> None:
        for some in itertools.batched(staged(), HELD):
            by_prefix: dict[str, list[str]] = {}
            for s, prefix in some:
                by_prefix.setdefault(prefix, []).append(s)
            list(pool.map(work, by_prefix, by_prefix.values()))

    with ThreadPoolExecutor(MOVERS) as pool:
        # once something is in, nothing more goes away
        if _kind(fs, f"{place}/{AWAY}") == pafs.FileType.NotFound:
            every(away, pool)
            fs.open_output_stream(f"{place}/{AWAY}").close()
        every(into, pool)
    fs.delete_dir(place)


class ObjectSink(DataSource):
    """Rows (prefix, object_key, data) as files below the option ``root``; each prefix is replaced."""

    @classmethod
    def name(cls) -> str:
        return "tamarack_objects"

    def schema(self) -> str:
        return "prefix string, object_key string, data binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["root"])


def write_objects(rows: DataFrame, root: str) -> None:
    """Write rows (prefix, object_key, data or text) and replace each prefix by them."""
    spark = rows.sparkSession
    spark.dataSource.register(ObjectSink)
    fs, path = opened(root)
    fs.create_dir(path, recursive=True)
    rows.select("prefix", "object_key", F.col("data").cast("binary").alias("data")).repartitionByRange("prefix", "object_key").write.format("tamarack_objects").option("root", root).mode("append").save()


def recover(root: str, abandoned: float = ABANDONED) -> int:
    """Finish commits that were cut off, and remove what was staged longer ago without one; how many were finished."""
    fs, path = opened(root)
    done = 0
    for place in fs.get_file_info(pafs.FileSelector(f"{path}/{STAGING}", allow_not_found=True)):
        if _kind(fs, f"{place.path}/{MARK}") == pafs.FileType.File:
            _publish(fs, path, place.path)
            done += 1
        elif place.mtime is None or time.time() - place.mtime.timestamp() >= abandoned:
            fs.delete_dir(place.path)
    return done


def _place(root: str, prefix: str) -> str:
    return f"{root.rstrip('/')}/{checked(prefix)}" if prefix else root


def _listed(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    listed = found(spark, _place(root, prefix))
    return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp") if listed is None else listed


def heads(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """object_key, size, modified of the objects below a prefix (or of the one with that key), contents unread."""
    key = relative_to(opened(root)[1], F.col("path"))
    return _listed(spark, root, prefix).select(key.alias("object_key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def bodies(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """object_key, data of the objects below a prefix."""
    key = relative_to(opened(root)[1], F.col("path"))
    return contents(_listed(spark, root, prefix), _place(root, prefix)).select(key.alias("object_key"), F.col("content").alias("data"))


def _pruned(fs: pafs.FileSystem, root: str, folder: str) -> None:
    while folder != root and not fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if _kind(fs, folder) == pafs.FileType.Directory:
            fs.delete_dir(folder)
        folder = folder.rpartition("/")[0]


def delete_objects(keys: DataFrame, root: str) -> DataFrame:
    """object_key, deleted: whether there was one; folders that are empty then go too."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(root)
        for batch in batches:
            names, gone = batch.column("object_key").to_pylist(), []
            for name in names:
                target = f"{path}/{checked(name)}"
                gone.append(_kind(fs, target) == pafs.FileType.File)
                if gone[-1]:
                    fs.delete_file(target)
                    _pruned(fs, path, target.rpartition("/")[0])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(gone, pa.bool_())], names=["object_key", "deleted"])

    return keys.select("object_key").mapInArrow(run, "object_key string, deleted boolean")


def delete_prefix(root: str, prefix: str) -> int:
    """Remove all below a prefix, or the object with that key; how many there were."""
    fs, path = opened(root)
    target = f"{path}/{checked(prefix.rstrip('/'))}"
    kind = _kind(fs, target)
    if kind == pafs.FileType.NotFound:
        return 0
    n = 1 if kind == pafs.FileType.File else sum(f.type == pafs.FileType.File for f in fs.get_file_info(pafs.FileSelector(target, recursive=True)))
    fs.delete_file(target) if kind == pafs.FileType.File else fs.delete_dir(target)
    _pruned(fs, path, target.rpartition("/")[0])
    return n

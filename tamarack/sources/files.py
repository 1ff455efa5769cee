"""Files as tables: scans, decoding, parsing by suffix, listings, previews.

Folders that pyarrow knows are listed and read by tasks, level after level, so that the
driver holds no list of files. Others are read through Spark's ``binaryFile`` source, so
any file system that Spark knows will do. Parsers of PDF and Office files, and vision models, are given
by the caller as functions of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import derive_heading, html_to_markdown, normalize_markdown, preview
from .scratch import scratch, written

#: Suffixes that are read, and encodings in the order in which they are tried.
SUFFIXES = (".pdf", ".docx", ".doc", ".pptx", ".xlsx", ".html", ".md")
ENCODINGS = ("utf-8", "utf-8-sig", "cp936", "gbk", "gb18030", "utf-16", "latin-1")
TEXT_SUFFIXES = (".md", ".html")
PREVIEW_CHARS, FILE_PREVIEW_CHARS = 1500, 3000
#: Folders that a task lists, files and bytes that it reads, about; bytes, and rows, that it sends on at once.
LISTED, READ_FILES, READ_BYTES, SEND_BYTES, SEND_ROWS = 2000, 20_000, 64 << 20, 4 << 20, 10_000


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def relative_to(root: str, path: Column) -> Column:
    """The path below a root, whatever its scheme looks like in Spark."""
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.contains(bare, F.lit(base)), F.substring(bare, F.instr(bare, base) + len(base), F.length(bare))).otherwise(bare)


def _base(fs: pafs.FileSystem, top: str, root: str) -> str:
    """How Spark writes the path of a root."""
    return f"file:{top}" if isinstance(fs, pafs.LocalFileSystem) else root.rstrip("/")


def found(spark: SparkSession, root: str) -> DataFrame | None:
    """path, length, modificationTime of all files below a root (or the one there), hidden ones left out; none is opened.

    None where there is nothing, and where pyarrow or the scratch folder can't serve.
    """
    try:
        fs, top = pafs.FileSystem.from_uri(root)
        top = top.rstrip("/")
        at = fs.get_file_info(top)
        scratch(spark)
    except (pa.ArrowInvalid, OSError, RuntimeError):
        return None
    base = _base(fs, top, root)
    if at.type == pafs.FileType.NotFound:
        return None

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for folder in batch.column("place").to_pylist():
                for f in fs.get_file_info(pafs.FileSelector(folder)):
                    if f.base_name[0] == "." or (f.base_name[0] == "_" and "=" not in f.base_name):
                        continue
                    rows.append((f.path, f.type == pafs.FileType.Directory, f.size or 0, (f.mtime_ns or 0) // 1_000_000 * 1000))
                    if len(rows) >= SEND_ROWS:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["place", "folder", "length", "changed"])

    kinds = "place string, folder boolean, length bigint, changed bigint"
    if at.type == pafs.FileType.File:
        files = spark.createDataFrame([(top, False, at.size, (at.mtime_ns or 0) // 1_000_000 * 1000)], kinds)
    else:
        folders, files = spark.createDataFrame([(top,)], "place string").coalesce(1), spark.createDataFrame([], kinds)
        while folders is not None:
            level = written(folders.mapInArrow(children, kinds))
            files, n = files.unionByName(level.where("not folder")), level.where("folder").count()
            folders = level.where("folder").select("place").repartition(max(min(n, spark.sparkContext.defaultParallelism), n // LISTED)) if n else None
    return files.select(F.concat(F.lit(base), F.substring("place", len(top) + 1, F.length("place"))).alias("path"), "length", F.timestamp_micros("changed").alias("modificationTime"))


def contents(files: DataFrame, root: str) -> DataFrame:
    """Rows of ``found`` with ``content``."""
    spark = files.sparkSession
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(root)
        top = top.rstrip("/")
        skip = len(_base(fs, top, root))
        for batch in batches:
            at, data, held = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                with fs.open_input_stream(top + path[skip:]) as f:
                    data.append(f.read())
                held += len(data[-1])
                if held >= SEND_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(at, len(data))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])
                    at, data, held = i + 1, [], 0

    spread = files.repartition(max(min(n, spark.sparkContext.defaultParallelism), n // READ_FILES, size // READ_BYTES, 1), "path")
    return spread.mapInArrow(run, "path string, length bigint, modificationTime timestamp, content binary")


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """relative_path, path, suffix, file_size, file_mtime, file_hash, bytes of the supported files, in no order."""
    listed = found(spark, root) if recursive else None
    if listed is None:
        return scanned(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root), root)
    return scanned(contents(listed.where(suffix(F.col("path")).isin(*SUFFIXES)), root), root)


def scan_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """As scan, of these files alone."""
    return scanned(spark.read.format("binaryFile").load(paths), root)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, path, file_size, file_mtime of the supported files; none is opened."""
    listed = found(spark, root)
    files = scan(spark, root) if listed is None else scanned(listed.withColumn("content", F.lit(None).cast("binary")), root)
    return files.select("relative_path", "path", "file_size", "file_mtime")


def scanned(files: DataFrame, root: str) -> DataFrame:
    """Rows of the ``binaryFile`` source, batch or stream, as rows of scan."""
    named = files.select(relative_to(root, F.col("path")).alias("relative_path"), "path", suffix(F.col("path")).alias("suffix"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"), F.sha2("content", 256).alias("file_hash"), F.col("content").alias("bytes"))
    return named.where(F.col("suffix").isin(*SUFFIXES))


def _valid(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def decode_any(data: Column) -> Column:
    """Text in the first encoding that fits; the last fits everything. What is UTF-8 doesn't cross to Python."""
    def one(b):
        for e in ENCODINGS:
            try:
                return bytes(b).decode(e)
            except UnicodeDecodeError:
                continue
        return None

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else one(b))

    return F.when(_valid(data), data.cast("string")).otherwise(F.pandas_udf(run, "string")(F.when(~_valid(data), data)))


def decode_utf8(data: Column) -> Column:
    """UTF-8 without the bytes that aren't.

    They become replacement characters, which are taken out; texts that have such characters
    of their own beside them go through Python.
    """
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    own = F.contains(data, F.unhex(F.lit("EFBFBD")))
    native = F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.when(_valid(data), data.cast("string")).when(~own, native).otherwise(F.pandas_udf(run, "string")(F.when(~_valid(data) & own, data)))


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """relative_path, file_hash, content, error: text of each file; what can't be parsed has an error, not an exception.

    ``parsers`` maps other suffixes to functions from bytes to markdown.
    """
    given = parsers or {}
    markdown = normalize_markdown(F.when(F.col("suffix") == ".html", html_to_markdown(decode_utf8(F.col("bytes")))).otherwise(decode_utf8(F.col("bytes"))))
    texts = files.where(F.col("suffix").isin(*TEXT_SUFFIXES)).select("relative_path", "file_hash", markdown.alias("content"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, digest, kind, data in zip(pdf.relative_path, pdf.file_hash, pdf.suffix, pdf.bytes, strict=True):
                try:
                    rows.append((path, digest, given[kind](bytes(data)) if kind in given else None, None if kind in given else f"unsupported_extension: {kind}"))
                except Exception as e:  # noqa: BLE001  a parser may fail in any way
                    rows.append((path, digest, None, f"parse_error: {e}"))
            yield pd.DataFrame(rows, columns=["relative_path", "file_hash", "content", "error"])

    others = files.where(~F.col("suffix").isin(*TEXT_SUFFIXES)).select("relative_path", "file_hash", "suffix", "bytes").mapInPandas(run, "relative_path string, file_hash string, content string, error string")
    return texts.unionByName(others)


def folder_preview(parsed: DataFrame, chars: int = PREVIEW_CHARS, lines: int = 30) -> DataFrame:
    """relative_path, status, characters, preview, by name."""
    shown = F.array_join(F.slice(F.split(F.substring(F.coalesce("content", F.lit("")), 1, chars), "\n"), 1, lines), "\n")
    return parsed.select("relative_path", F.when(F.col("error").isNull(), "ok").otherwise(F.col("error")).alias("status"), F.coalesce(F.length("content"), F.lit(0)).alias("characters"), shown.alias("preview")).orderBy("relative_path")


def file_preview(parsed: DataFrame, relative_path: str, chars: int = FILE_PREVIEW_CHARS) -> DataFrame:
    return parsed.where(F.col("relative_path") == relative_path).select("relative_path", preview(F.col("content"), chars).alias("preview"), derive_heading(F.col("content")).alias("heading"))


def list_directory(spark: SparkSession, folder: str) -> DataFrame:
    """name, kind, size of what is directly in a folder, by kind and name; empty if it doesn't exist."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(s.getPath().getName(), "directory" if s.isDirectory() else "file", s.getLen()) for s in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame(rows, "name string, kind string, size bigint").orderBy("kind", "name")


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """One row: current, parent (null at the top), folders (by name, hidden ones left out), files_count; error where it is no folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(path)
    parent = full.getParent()
    error = None if fs.exists(path) and fs.getFileStatus(path).isDirectory() else "not a directory" if fs.exists(path) else "path not found"
    inside = fs.listStatus(path) if error is None else []
    names = sorted(s.getPath().getName() for s in inside if s.isDirectory() and not s.getPath().getName().startswith("."))
    row = (full.toUri().getPath(), None if parent is None else parent.toUri().getPath(), names, sum(s.isFile() for s in inside), error)
    return spark.createDataFrame([row], "current string, parent string, folders array<string>, files_count bigint, error string")


def glob(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose relative path fits a glob (* within a folder, ** over folders, ?)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 3] == "**/":
            out, i = out + "(.*/)?", i + 3
            continue
        if pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r"\.^$|()[]{}+" else c)
        i += 1
    return files.where(F.col("relative_path").rlike(f"^{out}$")).orderBy("relative_path")

"""Parsing of large files: streams of bytes, in splits by size.

``register`` makes a Python data source of the caller's parsers. Its reader lists files
without opening them and deals them to splits of about equal size; where a parser can
begin anywhere (``splits``), a large file is several splits. A parser gets an open
stream, not bytes, and gives one text after another: no file and no list of texts is
ever held whole. What a parser raises is a row with an error behind the texts it has
given, and the other files go on.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .objects import opened

#: Bytes of a split, about, and what a file counts besides its bytes.
SPLIT, OPENING = 128 << 20, 1 << 20
#: Bytes that are read of a stream at once.
BUFFER = 1 << 20
#: Characters of texts that are sent on at once.
SEND = 4 << 20
ROWS = "relative_path string, start bigint, part int, content string, error string"


@dataclass(frozen=True)
class Parser:
    """``parse(stream, start, end)`` gives texts; ``end`` is None for a whole file.

    ``splits``: it can be given a range of bytes, and then takes what begins in it.
    """

    parse: Callable[[io.BufferedReader, int, int | None], Iterator[str]]
    splits: bool = False


def lines(stream: io.BufferedReader, start: int, end: int | None) -> Iterator[str]:
    """A parser that splits: the lines that begin within a range, undecodable bytes left out."""
    place = start
    if start:
        # a line that began before belongs to the range before
        stream.seek(start - 1)
        place = start - 1 + len(stream.readline())
    while end is None or place < end:
        line = stream.readline()
        if not line:
            return
        place += len(line)
        yield line.decode("utf-8", "ignore").rstrip("\r\n")


@dataclass
class Split(InputPartition):
    files: list[tuple[str, int, int | None]]  # path, first byte, byte behind the last or None for all


def dealt(files: list[tuple[str, int]], splits: Callable[[str], bool], size: int = SPLIT) -> list[Split]:
    """Files (path, bytes) as splits of about a size, in the order of paths."""
    out, held, weight = [], [], 0
    for path, n in sorted(files):
        ranges = [(path, a, min(a + size, n)) for a in range(0, n, size)] if n > size and splits(path) else [(path, 0, None)]
        for r in ranges:
            own = OPENING + (n if r[2] is None else r[2] - r[1])
            if held and weight + own > size + OPENING:
                out.append(Split(held))
                held, weight = [], 0
            held.append(r)
            weight += own
    return [*out, Split(held)] if held else out


class _Reader(DataSourceReader):
    def __init__(self, root: str, size: int, parsers: dict[str, Parser]):
        self.root, self.size, self.parsers = root, size, parsers

    def _parser(self, path: str) -> Parser | None:
        name = path.rpartition("/")[2]
        return self.parsers.get(name[name.rfind(".") :].lower()) if "." in name[1:] else None

    def partitions(self) -> list[Split]:
        fs, path = opened(self.root)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return dealt([(f.path, f.size) for f in found if f.type == pafs.FileType.File and self._parser(f.path)], lambda p: self._parser(p).splits, self.size)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.root)
        schema = pa.schema([("relative_path", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("content", pa.string()), ("error", pa.string())])
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for path, start, end in split.files if split else ():
            name, part = path.removeprefix(f"{root}/"), 0
            try:
                with fs.open_input_file(path) as raw, io.BufferedReader(raw, BUFFER) as stream:
                    for text in self._parser(path).parse(stream, start, end):
                        held.append((name, start, part, text, None))
                        part, size = part + 1, size + len(text)
                        if size >= SEND:
                            yield batch()
                            held, size = [], 0
            except Exception as e:  # noqa: BLE001  a parser may fail in any way
                held.append((name, start, part, None, f"parse_error: {e}"))
        if held:
            yield batch()


def register(spark: SparkSession, parsers: dict[str, Parser], name: str = "tamarack_files") -> None:
    """Make ``spark.read.format(name)`` of the parsers, by suffix (with its dot)."""
    class Files(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROWS

        def reader(self, schema) -> _Reader:
            return _Reader(self.options["root"], int(self.options.get("split", SPLIT)), parsers)

    spark.dataSource.register(Files)


def parsed_files(spark: SparkSession, root: str, parsers: dict[str, Parser], split: int = SPLIT) -> DataFrame:
    """relative_path, start, part, content, error: texts of all files below a root that have a parser, in parts of the range from ``start``."""
    register(spark, parsers)
    return spark.read.format("tamarack_files").option("root", root).option("split", split).load()

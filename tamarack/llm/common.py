"""What the training-data operators share: words, hashes, scratch tables, components.

Scratch tables are Parquet in the folder that ``spark.checkpoint.dir`` names, so
that they outlive any executor; where the setting is unset and the master is local
(tests), a temporary folder of this process is taken.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A-Z to a-z, on UTF-8 bytes; every other byte stays.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows and bytes of an Arrow batch: whole texts can be long, so batches are kept small.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20
M64 = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the rows and, as texts can be very long, the bytes that cross to Python at once; the same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


@functools.cache
def _own_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="tamarack-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


_made: set[str] = set()
#: Folders that were made since ``finished`` began, where one is at work.
_on_the_way: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_on_the_way", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when this process ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{(root or _own_scratch()).rstrip('/')}/tamarack-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made.add(folder)
    if (made := _on_the_way.get()) is not None:
        made.append(folder)
    return folder


def _forget() -> None:
    spark = SparkSession.getActiveSession()
    for folder in _made if spark is not None else ():
        with contextlib.suppress(Exception):  # the session may be gone already
            discard(spark, folder)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, True)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage where a result is used twice.

    Shuffles that made the table are removed once it is written.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; scratch tables that were made on the way are removed."""
    made: list[str] = []
    token = _on_the_way.set(made)
    try:
        df = make()
    finally:
        _on_the_way.reset(token)
    out = materialize(df, name)
    for folder in made:
        discard(spark, folder)
        _made.discard(folder)
    return out


def words_of(text: str | None) -> list[bytes]:
    r"""The words ``[^\x20\x09-\x0D]+`` as UTF-8 bytes: bytes.split() cuts at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 500_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, elementwise."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def _powers(k: int, odd: int) -> np.ndarray:
    return np.array([pow(odd, k - 1 - i, 1 << 64) for i in range(k)], np.uint64)


def gram_hashes(h: np.ndarray, k: int, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of each run of k words, from the words' hashes (a polynomial, then mixed)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, p in enumerate(_powers(k, odd)):
        out += h[i : i + n] * p
    return mix64(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; shorter texts are one shingle, no words none."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, min(k, len(h))))


def map_frames(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas whose whole-number columns stay whole where some are null (else ids beyond 2^53 would be rounded)."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=kind, preserve_index=False)

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows that follow each other with equal keys, over batch borders."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[k].to_numpy() for k in keys]
        marks = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        for a, b in zip(marks, [*marks[1:], len(pdf)], strict=True):
            part = pdf.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if key != last and held:
                yield last, held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield last, held[0] if len(held) == 1 else pd.concat(held)


def per_sorted_group(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply fn to each group; groups share a Python call, unlike applyInPandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, group in sorted_groups(batches, keys):
            out = fn(key, group)
            if out is not None and len(out):
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).transform(map_frames, run, schema)


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, component (smallest reachable node) of undirected edges (src, dst), both bigint.

    Alternates large-star and small-star steps until nothing changes, or fails where
    ``max_rounds`` are not enough; each step is a written table, which keeps plans short. Sums of hashes, not rows, come to the driver.
    """
    def min_of(directed: DataFrame) -> DataFrame:
        return directed.groupBy("u").agg(F.min("v").alias("m"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = mark(e)
    rounds = 0
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"components still changed after {max_rounds} rounds")
        rounds += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = min_of(both).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = min_of(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

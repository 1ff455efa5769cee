"""Product codes of vectors: every vector becomes one byte for each of its parts.

Components become integers, floor(1024 x), so that all sums are exact and no order
of adding changes a result. A vector is cut into equal consecutive parts; each part
position has a codebook that starts as that part of the vectors with the smallest
ids. A round assigns each part to its nearest entry and moves every entry to the
floor of its parts' mean; an entry without parts stays.

The integers are written once, as blocks of some thousand vectors whose dimensions
lie one after another. A round is one ``treeAggregate`` over these blocks: distances
to all entries accumulate dimension by dimension, sums and counts of a task are one
tensor of the codebooks' size, and tensors merge along a tree, so the driver sees a
bounded number of them whatever the input. Nothing is shuffled by vector, so equal
vectors, however many, aren't a hot key.

Defined cases: a vector that is null, or holds a null or a number that isn't finite,
is dropped; one whose length isn't that of the first (by id, then by components), or
can't be cut into equal parts, is returned without code and error; rows that share an
id are coded each; rows without an id are coded, but aren't entries at the start; with
fewer vectors than entries the codebooks are shorter; an empty table gives no rows;
components too large for 64-bit distances are computed with Python's integers, and an
error above 64 bits is null; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, read

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and vectors whose distances are computed at once (they stay in a core's cache).
BLOCK, AT_ONCE = 4096, 256
#: Partial tensors that one task merges.
FAN_IN = 32
#: A label with at least this share of the rows is joined by broadcast: there are at most as many as its inverse.
HOT_SHARE = 0.001

Books = list[np.ndarray]  # for each part: entries x dimensions of the part


def number_kind(largest: int, dim: int, rows: int) -> type:
    """The narrowest integers in which no distance and no sum of ``rows`` components can overflow."""
    distance, total = 4 * largest * largest * max(dim, 1), largest * max(rows, 1)
    if distance < 1 << 31:
        return np.int32
    return np.int64 if max(distance, total) < 1 << 63 else object


def whole(x: np.ndarray, scale: int, kind: type) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly."""
    if kind is not object:
        return np.floor(x * scale).astype(kind)
    return np.frompyfunc(lambda v: math.floor(int(v) * scale if float(v).is_integer() else v * scale), 1, 1)(x)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of ``part`` (dimensions x vectors); ties go to the lower entry."""
    n = part.shape[1]
    code, error = np.zeros(n, np.int64), np.zeros(n, object if part.dtype == object else np.int64)
    for at in range(0, n, AT_ONCE):
        x = part[:, at : at + AT_ONCE]
        distance = np.zeros((x.shape[1], len(book)), part.dtype)
        for row, entry in zip(x, book.T, strict=True):
            step = row[:, None] - entry[None]
            step *= step
            distance += step
        best = distance.argmin(axis=1)
        code[at : at + AT_ONCE] = best
        error[at : at + AT_ONCE] = distance[np.arange(len(best)), best]
    return code, error


def _columns(batch: pa.RecordBatch, dim: int, scale: int, kind: type) -> np.ndarray:
    """dimensions x vectors of a batch's ``vector``."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(whole(flat.reshape(batch.num_rows, dim).astype(np.float64), scale, kind).T)


def _pack(block: np.ndarray) -> bytes:
    return pickle.dumps(block) if block.dtype == object else block.tobytes()


def _unpack(data: bytes, dim: int, n: int, kind: type) -> np.ndarray:
    return pickle.loads(bytes(data)) if kind is object else np.frombuffer(data, kind).reshape(dim, n)


def part_blocks(vectors: DataFrame, dim: int, scale: int, kind: type) -> DataFrame:
    """n, block: the integers of some thousand vectors, one dimension after another."""
    out = pa.schema([("n", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([_pack(np.concatenate(held, axis=1))], pa.binary())], schema=out)

        for batch in batches:
            if batch.num_rows:
                held.append(_columns(batch, dim, scale, kind))
                n += batch.num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return vectors.select("vector").mapInArrow(run, "n int, block binary")


def refined(blocks: RDD, books: Books, kind: type) -> Books:
    """Codebooks after one round; ``blocks`` are dimensions x vectors."""
    shared = blocks.context.broadcast(books)  # as large as the codebooks, whatever the input
    wide = object if kind is object else np.int64
    zero = [(np.zeros(book.shape, wide), np.zeros(len(book), np.int64)) for book in books]

    def add(tensors: list, block: np.ndarray) -> list:
        at = 0
        for (sums, counts), book in zip(tensors, shared.value, strict=True):
            part = block[at : at + book.shape[1]]
            at += book.shape[1]
            code, _ = nearest(part, book)
            np.add.at(sums, code, part.T.astype(wide))
            np.add.at(counts, code, 1)
        return tensors

    def merge(a: list, b: list) -> list:
        for (sums, counts), (more, further) in zip(a, b, strict=True):
            sums += more
            counts += further
        return a

    depth = max(2, math.ceil(math.log(max(blocks.getNumPartitions(), 2), FAN_IN)))
    tensors = blocks.treeAggregate(zero, add, merge, depth)
    shared.unpersist()
    return [np.where((counts > 0)[:, None], sums // np.maximum(counts, 1)[:, None], book).astype(kind) for (sums, counts), book in zip(tensors, books, strict=True)]


def books_sha256(books: Books) -> str:
    """Of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def coded(vectors: DataFrame, books: Books, dim: int, scale: int, kind: type) -> DataFrame:
    """The other columns of ``vectors`` with code and error."""
    rest = [f for f in vectors.schema if f.name != "vector"]
    schema = T.StructType([*rest, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    out = to_arrow_schema(schema)
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch, dim, scale, kind)
            at, codes, total = 0, [], np.zeros(batch.num_rows, object if kind is object else np.int64)
            for book in books:
                code, error = nearest(x[at : at + book.shape[1]], book)
                at += book.shape[1]
                codes.append(code.astype(np.uint8))
                total = total + error
            text = np.stack(codes, axis=1).tobytes().hex()
            width = 2 * len(books)
            own = [batch.column(f.name).cast(out.field(f.name).type) for f in rest]
            yield pa.RecordBatch.from_arrays([*own, pa.array([text[i * width : (i + 1) * width] for i in range(batch.num_rows)], pa.string()), pa.array([int(e) if e <= most else None for e in total], pa.int64())], schema=out)

    return vectors.mapInArrow(run, schema)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (label, error and others) with the sum of the errors of all rows of the label.

    Sums of labels that hold many rows are few and go to every task; the others', whose
    number grows with the input, meet their rows in a shuffle without hot keys.
    """
    totals = materialize(rows.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_rows")), "totals")
    every = totals.agg(F.sum("_rows")).first()[0] or 0
    is_hot, same = F.col("_rows") >= max(1, HOT_SHARE * every), F.col("label").eqNullSafe(F.col("_label"))
    known = rows.join(F.broadcast(totals.where(is_hot)), same, "left")
    rare = known.where("_rows is null").select(rows.columns).join(totals.where(~is_hot), same)
    return known.where("_rows is not null").unionByName(rare).drop("_label", "_rows")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(id, code, error, label_error; the final codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    kept = kept.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    first = kept.where("id is not null").orderBy("id", "vector").limit(1).select(F.size("vector")).first()
    dim = first[0] if first else -1
    fits = (F.size("vector") == dim) & F.lit(dim >= 0 and dim % parts == 0)
    fitting = kept.where(fits)
    seeds = np.array([r[0] for r in fitting.where("id is not null").orderBy("id", "vector").limit(entries).select("vector").collect()], np.float64)  # at most ``entries`` rows
    without = kept.where(~fits).select("id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), "label")
    books: Books = []
    if len(seeds):
        largest, n = fitting.agg(F.coalesce(F.max(F.array_max(F.transform("vector", F.abs))), F.lit(0.0)), F.count("*")).first()
        kind = number_kind(math.floor(int(largest) * scale if float(largest).is_integer() else largest * scale) + 1, dim, n)
        books = np.split(whole(seeds.reshape(len(seeds), dim), scale, kind), parts, axis=1)
        blocks = materialize(part_blocks(fitting, dim, scale, kind), "blocks").rdd.map(lambda row: _unpack(row.block, dim, row.n, kind))
        for _ in range(rounds):
            books = refined(blocks, books, kind)
        rows = coded(fitting, books, dim, scale, kind).select("id", "code", "error", "label").unionByName(without)
    else:
        rows = without
    named = with_label_errors(materialize(rows, "codes"))
    return named.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 4 parts, 256 entries each, 4 rounds."""
    codes, books = vector_codes(read(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books_sha256(books)))


def op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL: every round is a step of its own."""
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, i AS part, v[i * (len(v) // {parts}) + 1:(i + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) t(i))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM s JOIN p USING (r))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := entry)) AS m FROM p JOIN b{i} USING (part) GROUP BY r, part)")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT part, entry, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
  SELECT part, m.entry AS entry, j, sum(x[j + 1]) AS t, count(*) AS n FROM a{i} JOIN p USING (r, part), range((SELECT max(len(x)) FROM p)) g(j) GROUP BY 1, 2, 3) GROUP BY part, entry)""")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry))")
    steps.append(f"f AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h"

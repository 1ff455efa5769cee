"""An index of vectors for cosine search: cells, codes of residuals, exact scores.

Vectors are scaled to length one. A k-means over a bounded sample gives cells; what is
left of a vector after its cell's centre is cut into parts, and each part is the number
of its nearest entry in a codebook that a k-means over the sample's residuals gives.
Every row is indexed, in the order of its cell: id, code, and the vector beside it.

A search takes each query's nearest cells (probes). Reading their codes alone, tasks
add up an estimate for each row from tables of the query's products with centres and
entries, and keep each query's best; the best of all tasks are scored exactly on the
vectors, of which again only those cells are read. Found scores are exact, but a row in
no probed cell is missed. How many cells must be probed depends on the vectors: it is
measured when the index is made, on queries of the sample against the sample, in which
neighbours are farther than among all rows.

Defined cases: a vector that is null, zero, or of another length than the index has no
direction and a cosine of 0, as in ``search.vector_search``; such rows are in a cell of
their own, and those with the smallest ids compete; a query without direction gets the
smallest ids of all. Rows that share an id are found each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scoring import cosine
from ..sources.scratch import scratch

#: Cells and entries of a codebook at most, dimensions of a part, rounds of the k-means.
MOST_CELLS, ENTRIES, PART, ROUNDS = 65_536, 256, 4, 8
#: Rows that the k-means learns from, about; all rows are indexed.
SAMPLE = 200_000
#: Queries and neighbours of each on which probes are measured, and the share of the neighbours that must be met.
MEASURED, NEIGHBOURS, MET = 128, 10, 0.97
#: Products that are held at once.
HELD = 1 << 22
#: The cell of rows without direction.
NOWHERE = -1
#: Queries of one search at most: they go to all tasks.
MOST_QUERIES = 10_000


@dataclass
class CellIndex:
    path: str
    centres: np.ndarray  # cells x dimensions
    books: np.ndarray  # parts x entries x dimensions of a part; dimensions are padded with zeros
    probes: int = 1

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def nearest(x: np.ndarray, entries: np.ndarray, best: int = 1) -> np.ndarray:
    """Numbers of the nearest entries (Euclid) of each row, nearest first: rows x best."""
    half = (entries * entries).sum(axis=1) / 2
    out = np.empty((len(x), best), np.int64)
    step = max(1, HELD // max(len(entries), 1))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ entries.T - half
        if best == 1:
            out[at : at + step, 0] = near.argmax(axis=1)
            continue
        top = np.argpartition(-near, best - 1, axis=1)[:, :best] if best < len(entries) else np.tile(np.arange(len(entries)), (len(near), 1))[:, :best]
        out[at : at + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def split(x: np.ndarray) -> np.ndarray:
    """rows x parts x PART, padded with zeros."""
    parts = math.ceil(x.shape[1] / PART)
    return np.pad(x, ((0, 0), (0, parts * PART - x.shape[1]))).reshape(len(x), parts, PART)


def _refined(blocks: RDD, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries' means after one round; a block is a list of arrays, one for each book."""
    shared = blocks.context.broadcast(books)
    zero = [np.zeros((len(b), b.shape[1] + 1)) for b in books]

    def add(totals: list[np.ndarray], block: list[np.ndarray]) -> list[np.ndarray]:
        for total, x, book in zip(totals, block, shared.value, strict=True):
            np.add.at(total, nearest(x, book)[:, 0], np.concatenate([x, np.ones((len(x), 1))], axis=1))
        return totals

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        for x, y in zip(a, b, strict=True):
            x += y
        return a

    totals = blocks.treeAggregate(zero, add, merge, 3)
    shared.unpersist()
    return [np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1), b).astype(np.float32) for t, b in zip(totals, books, strict=True)]


def _probes(rows: RDD, centres: np.ndarray, queries: np.ndarray) -> int:
    """Cells to probe so that MET of the queries' nearest sampled rows are in them."""
    shared = rows.context.broadcast((centres, queries))
    empty = np.full((len(queries), NEIGHBOURS), -2.0), np.zeros((len(queries), NEIGHBOURS), np.int64)

    def best(scores: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :NEIGHBOURS]
        return np.take_along_axis(scores, at, axis=1), np.take_along_axis(cells, at, axis=1)

    def add(top: tuple, x: np.ndarray) -> tuple:
        centres, queries = shared.value
        cells = np.tile(nearest(x, centres)[:, 0], (len(queries), 1))
        return merge(top, (queries @ x.T, cells))

    def merge(a: tuple, b: tuple) -> tuple:
        return best(*(np.concatenate(pair, axis=1) for pair in zip(a, b, strict=True)))

    scores, cells = rows.treeAggregate(empty, add, merge, 3)
    order = nearest(queries, centres, len(centres))
    places = np.argmax(order[:, :, None] == cells[:, None, :], axis=1)[scores > -2]
    return int(np.quantile(places, MET, method="higher")) + 1 if places.size else 1


def _directed(vector: Column, dim: int) -> Column:
    """Whether a vector of doubles has a direction among those of this length."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _fitted(directed: DataFrame, dim: int, cells: int, rounds: int, sample: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(centres, books, probes) of rows (key, vector), learnt from a sample of bounded size."""
    spark, n = directed.sparkSession, directed.count()
    drawn = directed.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < math.ceil(min(1.0, sample / max(n, 1)) * (1 << 20)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([unit(_matrix(b.column("vector"), dim)).tobytes()])], names=["block"])

    path = scratch(spark)
    drawn.select("vector").mapInArrow(blocks, "block binary").write.parquet(path)
    rows = spark.read.parquet(path).rdd.map(lambda r: np.frombuffer(r.block, np.float32).reshape(-1, dim))
    first = drawn.orderBy(F.xxhash64("key"), "key").limit(max(cells, MEASURED)).select("vector").toArrow()["vector"].combine_chunks()
    queries = unit(_matrix(first, dim))
    centres = queries[:cells]
    for _ in range(rounds):
        centres = _refined(rows.map(lambda x: [x]), [centres])[0]
    shared = spark.sparkContext.broadcast(centres)
    residuals = rows.map(lambda x: list(np.moveaxis(split(x - shared.value[nearest(x, shared.value)[:, 0]]), 1, 0)))
    start = np.concatenate(residuals.map(lambda parts: np.stack([p[:ENTRIES] for p in parts])).take(ENTRIES), axis=1)[:, :ENTRIES]  # a block has one row at least
    books = list(start)
    for _ in range(rounds):
        books = _refined(residuals, books)
    return centres, np.stack(books), _probes(rows, centres, queries[-MEASURED:])


def write_cells(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, rounds: int = ROUNDS, sample: int = SAMPLE) -> CellIndex:
    """Index all rows below a path that is free; the number of cells is the root of theirs unless it is given."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    lengths = plain.where("vector is not null and size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    directed = plain.where(_directed(F.col("vector"), dim)).withColumn("key", F.xxhash64("id", "vector"))
    n = directed.count()
    if n:
        centres, books, probes = _fitted(directed, dim, min(MOST_CELLS, cells or math.ceil(math.sqrt(n)), n), rounds, sample)
    else:
        centres, books, probes = np.zeros((0, dim), np.float32), np.zeros((0, 0, PART), np.float32), 1
    shared = spark.sparkContext.broadcast((centres, books))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for b in batches:
            x = unit(_matrix(b.column("vector"), dim))
            cell = nearest(x, centres)[:, 0] if len(x) else np.empty(0, np.int64)
            parts = split(x - centres[cell])
            codes = np.stack([nearest(parts[:, p], book)[:, 0].astype(np.uint8) for p, book in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "vector", "cell", "code"])

    kind = plain.schema["id"].dataType.simpleString()
    coded = directed.select("id", "vector").mapInArrow(code, f"id {kind}, vector array<double>, cell int, code binary")
    rest = plain.where(~_directed(F.col("vector"), dim)).select("id", "vector", F.lit(NOWHERE).alias("cell"), F.lit(None).cast("binary").alias("code"))
    # in the order of cells, large cells over several files: a filter on cells skips files and parts of them
    coded.unionByName(rest).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/rows")
    model = [("centres", *centres.shape, 1, centres.tobytes()), ("books", *books.shape, books.tobytes()), ("probes", probes, 0, 0, b"")]
    spark.createDataFrame(model, "name string, a int, b int, c int, data binary").coalesce(1).write.parquet(f"{path}/model")
    return CellIndex(path, centres, books, probes)


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    model = {r.name: r for r in spark.read.parquet(f"{path}/model").collect()}
    centres, books = (np.frombuffer(r.data, np.float32).reshape(r.a, r.b, r.c) for r in (model["centres"], model["books"]))
    return CellIndex(path, centres[:, :, 0], books, model["probes"].a)


def cell_search(index: CellIndex, queries: DataFrame, limit: int, probes: int | None = None, candidates: int | None = None, digits: int = 6, id_col: str = "vec_id") -> DataFrame:
    """query_id, id, score, rank of queries (query_id, query): as ``search.vector_search_batch``, from the nearest cells.

    ``probes``: cells to look in, unless given as many as were measured. ``candidates``: rows that are
    scored exactly for each query, unless given thirty times the limit.
    """
    spark = queries.sparkSession
    rows, most = spark.read.parquet(f"{index.path}/rows"), max(limit, candidates or 30 * limit)
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    named = asked.limit(MOST_QUERIES + 1).collect()  # a stated set, which goes to all tasks
    if len(named) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: search them in blocks")
    wanted = [i for i, r in enumerate(named) if r.query is not None and len(r.query) == index.dim and all(x is not None and math.isfinite(x) for x in r.query) and any(r.query)]
    q = unit(np.array([named[i].query for i in wanted], np.float64).reshape(len(wanted), index.dim))
    probed = nearest(q, index.centres, min(probes or index.probes, len(index.centres))) if len(index.centres) and len(q) else np.empty((len(q), 0), np.int64)
    asked = spark.createDataFrame([(i, r.query_id, r.query) for i, r in enumerate(named)], f"number int, query_id {asked.schema['query_id'].dataType.simpleString()}, query array<double>")
    cells = sorted(set(probed.ravel().tolist()))
    by_cell = {c: np.flatnonzero((probed == c).any(axis=1)) for c in cells}
    shared = spark.sparkContext.broadcast((q, wanted, by_cell, index.centres, index.books))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, wanted, by_cell, centres, books = shared.value
        # for each query, its products with all entries of all parts
        tables = np.einsum("qpd,ped->qpe", split(q), books)
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            ids = batch.column("id").to_pandas(integer_object_nulls=True)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                for i in by_cell[int(c)]:
                    score = q[i] @ centres[c] + tables[i][np.arange(len(books)), codes[at]].sum(axis=1)
                    mine = pd.DataFrame({"cell": c, "id": ids.iloc[at].to_numpy(), "estimate": score})
                    held = pd.concat([best[i], mine]) if i in best else mine
                    best[i] = held.sort_values(["estimate", "id"], ascending=[False, True]).head(most) if len(held) > most else held
        for i, held in best.items():
            yield pa.RecordBatch.from_pandas(held.assign(number=wanted[i]).astype({"number": np.int32, "cell": np.int32})[["number", "cell", "id", "estimate"]], preserve_index=False, schema=pa.schema([("number", pa.int32()), ("cell", pa.int32()), ("id", kind), ("estimate", pa.float64())]))

    id_type = rows.schema["id"].dataType.simpleString()
    kind = spark.createDataFrame([], f"id {id_type}").toArrow().schema.field("id").type
    near = rows.where(F.col("cell").isin(cells)).select("cell", "id", "code").mapInArrow(estimate, f"number int, cell int, id {id_type}, estimate double")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("estimate"), "id"))
    chosen = near.withColumn("_place", place).where(F.col("_place") <= most).select("number", "cell", "id").distinct()
    # at most ``most`` for each query; their vectors are read from the probed cells alone
    vectors, chosen = rows.where(F.col("cell").isin(cells)).select("cell", "id", "vector"), chosen.withColumnsRenamed({"cell": "_cell", "id": "_id"})
    pairs = vectors.join(F.broadcast(chosen), (F.col("cell") == F.col("_cell")) & F.col("id").eqNullSafe(F.col("_id")))
    zero = rows.where(F.col("cell") == NOWHERE).select("id").orderBy("id").limit(limit).crossJoin(F.broadcast(asked.select("number")))  # ``limit`` rows for each query
    plain = asked.where(~_directed(F.col("query"), index.dim)).select("number")
    first = rows.select("id").orderBy("id").limit(limit).crossJoin(F.broadcast(plain))  # the same
    scored = pairs.join(F.broadcast(asked), "number").select("number", "id", F.round(cosine(F.col("vector"), F.col("query")), digits).alias("score"))
    every = scored.unionByName(zero.join(F.broadcast(asked.where(_directed(F.col("query"), index.dim)).select("number")), "number", "left_semi").unionByName(first).withColumn("score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= limit).join(F.broadcast(asked.select("number", "query_id")), "number").select("query_id", F.col("id").alias(id_col), "score", "rank")

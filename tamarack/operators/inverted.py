"""An inverted index of texts: keyword and page search that read few of them.

A segment has three tables. ``texts`` lie in the order of path and position, some
thousand in a file (a block). ``postings`` say for each run of three characters
(gram) which rows of a block contain it and how often, with the most of any row
beside it; they lie by gram in buckets, so a search opens those of its terms alone.
``blocks`` names each block's file and first row.

A term can occur only in rows that have all its grams, and no more often than the
rarest of them there. So a search knows, from the columns of block bests alone, what
a block's best row can score at most. It goes through the blocks from the highest
bound on, earlier paths first, some at a time and four times as many each time: their
rows' postings sharpen the bounds, the files of those that can still give a row of the
result are read, and rows are scored on their texts as in the search without index.
It ends when no block that is left can hold a better row than the last of the result.

Rows are never changed in place: a changed document is removed up to a segment's
number, and added in a new one. Results are those of ``search.keyword_search`` and
``pages.page_search``. Terms of under three characters have no grams: blocks aren't
ruled out by them, and a query of such terms alone reads all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions.arrow import short_batches
from ..functions.scoring import keyword_score, page_terms, query_terms
from .filters import Condition
from .pages import page_search
from .search import active

#: Rows of a text file, and rows of a block whose postings are made at once.
BLOCK_ROWS, PIECE_ROWS = 8192, 2048
#: Grams of rows, about, at which a piece ends before.
PIECE_GRAMS = 1 << 20
#: Buckets of postings.
BUCKETS = 61
#: Blocks that the first step looks at, and that any looks at.
FIRST, MOST = 8, 4096

TEXTS = "doc_id {id}, relative_path string, position int, heading string, text string"
POSTINGS = "gram bigint, field int, block bigint, piece bigint, most int, rows array<int>, counts array<int>"


@dataclass(frozen=True)
class Segment:
    path: str
    number: int = 0


@dataclass
class Found:
    """The result, and what was read for it."""

    rows: DataFrame
    files: list[str] = field(default_factory=list)
    blocks: int = 0


def grams(text: str) -> np.ndarray:
    """A number for each run of three characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _postings(texts: DataFrame) -> DataFrame:
    """POSTINGS of rows (block, row, text, heading), which come in the order of block and row."""
    kinds = [("gram", pa.int64()), ("field", pa.int32()), ("block", pa.int64()), ("piece", pa.int64()), ("most", pa.int32()), ("rows", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, piece, n, size = None, 0, 0, 0
        held: tuple[list, list] = ([], [])

        def flushed() -> Iterator[pa.RecordBatch]:
            for number, parts in enumerate(held):
                if not parts:
                    continue
                code, row, count = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(code, kind="stable")
                code, row, count = code[order], row[order], count[order]
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                ends = pa.array(np.r_[starts, len(code)].astype(np.int32))
                m = len(starts)
                columns = [code[starts], np.full(m, number, np.int32), np.full(m, block), np.full(m, piece), np.maximum.reduceat(count, starts)]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (row, count)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), *lists], schema=schema)
                parts.clear()

        for batch in batches:
            for b, r, *fields in zip(*(batch.column(c).to_pylist() for c in ("block", "row", "text", "heading")), strict=True):
                if b != block or n >= PIECE_ROWS or size >= PIECE_GRAMS:
                    yield from flushed()
                    block, piece, n, size = b, r, 0, 0
                n += 1
                for parts, text in zip(held, fields, strict=True):
                    if text and len(text) > 2:
                        code, count = np.unique(grams(text), return_counts=True)
                        parts.append((code, np.full(len(code), r, np.int32), count.astype(np.int32)))
                        size += len(code)
        yield from flushed()

    short_batches(texts.sparkSession)
    return texts.mapInArrow(run, POSTINGS)


def write_segment(rows: DataFrame, path: str, number: int = 0, block_rows: int = BLOCK_ROWS) -> Segment:
    """Index rows (doc_id, relative_path, position, text, and heading if they have one) below a path that is free."""
    spark = rows.sparkSession
    heading = F.col("heading") if "heading" in rows.columns else F.lit(None)
    plain = rows.select("doc_id", F.coalesce("relative_path", F.lit("")).alias("relative_path"), F.col("position").cast("int").alias("position"), heading.cast("string").alias("heading"), "text")
    plain.repartitionByRange("relative_path", "position").sortWithinPartitions("relative_path", "position").write.option("maxRecordsPerFile", block_rows).parquet(f"{path}/texts")
    texts = spark.read.schema(plain.schema).parquet(f"{path}/texts")
    name = F.col("_metadata.file_name")
    # files of one write are numbered in the order of their rows
    block = F.regexp_extract(name, r"^part-(\d+)-", 1).cast("bigint") * (1 << 20) + F.regexp_extract(name, r"-c(\d+)\.", 1).cast("bigint")
    texts.select(block.alias("block"), name.alias("file"), F.struct("relative_path", "position").alias("first")).groupBy("block", "file").agg(F.min("first").alias("first")).write.parquet(f"{path}/blocks")
    numbered = texts.select(block.alias("block"), F.col("_metadata.row_index").alias("row"), F.lower("text").alias("text"), F.lower("heading").alias("heading"))
    order = ["bucket", "gram", "block"]
    _postings(numbered).withColumn("bucket", F.pmod("gram", F.lit(BUCKETS))).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/postings")
    return Segment(path, number)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class _Search:
    """One query over segments: bounds of blocks, and the walk through them."""

    def __init__(self, spark: SparkSession, segments: list[Segment], terms: list[str], weight: Callable[[int, int], float], counts: bool, id_type: str):
        self.spark, self.segments, self.counts, self.id_type = spark, segments, counts, id_type
        wanted = [(int(g), t, f, len(set(grams(term).tolist())), float(weight(t, f))) for t, term in enumerate(terms) if len(term) > 2 for g in set(grams(term).tolist()) for f in ((0, 1) if counts else (0,))]
        short = sum(len(t) < 3 for t in terms)
        #: What terms without grams may add to any row's score.
        self.open = (math.inf if counts else float(short)) if short else 0.0
        self.codes = sorted({w[0] for w in wanted})
        self.wanted = spark.createDataFrame(wanted, "gram bigint, term int, field int, n int, weight double")

    def _hits(self) -> DataFrame:
        """Postings of the query's grams; its buckets and grams reach the scan as filters."""
        buckets = sorted({c % BUCKETS for c in self.codes})
        parts = [self.spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{s.path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(self.codes)).withColumn("segment", F.lit(s.number)) for s in self.segments]
        return _union(parts).join(F.broadcast(self.wanted), ["gram", "field"])

    def _bounds(self, hits: DataFrame) -> DataFrame:
        """segment, block, bound from (segment, block, part, term, field, n, weight, m): a part has a term if it has all its grams."""
        each = hits.groupBy("segment", "block", "part", "term", "field", "n", "weight").agg(F.count("*").alias("have"), F.min("m").alias("m")).where("have = n")
        share = F.col("weight") * (F.col("m") if self.counts else 1)
        return each.groupBy("segment", "block", "part").agg(F.sum(share).alias("bound")).groupBy("segment", "block").agg(F.max("bound").alias("bound"))

    def coarse(self) -> DataFrame:
        """segment, block, file, bound, place of the blocks that may have a row; places are in the order of the walk."""
        every = _union([self.spark.read.parquet(f"{s.path}/blocks").withColumn("segment", F.lit(s.number)) for s in self.segments])
        bounds = self._bounds(self._hits().select("segment", "block", F.col("piece").alias("part"), "term", "field", "n", "weight", F.col("most").alias("m")))
        met = every.join(bounds, ["segment", "block"], "left" if self.open else "inner").withColumn("bound", F.coalesce("bound", F.lit(0.0)) + self.open)
        return met.withColumn("place", F.struct((-F.col("bound")).alias("bound"), F.col("first.relative_path").alias("path"), F.col("first.position").alias("position"), "segment", "block"))

    def fine(self, blocks: list[Row]) -> dict[tuple[int, int], float]:
        """Bounds of some blocks from the postings of their rows; blocks without a row that may score are missing."""
        if self.open:
            return {(b.segment, b.block): b.bound for b in blocks}
        chosen = self.spark.createDataFrame([(b.segment, b.block) for b in blocks], "segment int, block bigint")
        hits = self._hits().where(F.col("block").isin(sorted({b.block for b in blocks}))).join(F.broadcast(chosen), ["segment", "block"])
        rows = hits.select("segment", "block", "term", "field", "n", "weight", F.explode(F.arrays_zip("rows", "counts")).alias("x"))
        return {(r.segment, r.block): r.bound for r in self._bounds(rows.select("segment", "block", F.col("x.rows").alias("part"), "term", "field", "n", "weight", F.col("x.counts").alias("m"))).collect()}

    def walk(self, scored: Callable[[DataFrame], DataFrame], key: Callable[[Row], tuple], may_beat: Callable[[float, tuple, Row], bool], limit: int) -> tuple[list[Row], list[str], int]:
        """(the best rows, the text files read, blocks whose rows' postings were read)."""
        paths = {s.number: s.path for s in self.segments}
        coarse, best, files, looked, size, last = self.coarse(), [], [], 0, FIRST, None
        while True:
            rest = coarse if last is None else coarse.where(F.col("place") > F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last.place, coarse.schema["place"].dataType, strict=True))))
            blocks = rest.orderBy("place").limit(size).collect()
            if not blocks:
                break
            looked += len(blocks)
            sharp = self.fine(blocks)
            read = [f"{paths[b.segment]}/texts/{b.file}" for b in blocks if (b.segment, b.block) in sharp and (len(best) < limit or may_beat(sharp[b.segment, b.block], tuple(b.first), best[-1]))]
            if read:
                texts = _union([self.spark.read.schema(TEXTS.format(id=self.id_type)).parquet(*part).withColumn("segment", F.lit(n)) for n, p in paths.items() if (part := [r for r in read if r.startswith(f"{p}/texts/")])])
                files += texts.inputFiles()
                best = sorted([*best, *scored(texts).collect()], key=key)[:limit]
            last = blocks[-1]
            if len(blocks) < size or (len(best) >= limit and not may_beat(last.bound, tuple(last.first), best[-1])):
                break
            size = min(4 * size, MOST)
        return best, files, looked


def _standing(texts: DataFrame, removed: DataFrame | None) -> DataFrame:
    """Rows of documents that weren't removed (doc_id, up_to) at their segment or later."""
    if removed is None:
        return texts.drop("segment")
    gone = removed.select("doc_id", "up_to")
    return texts.join(gone, (texts.doc_id == gone.doc_id) & (texts.segment <= gone.up_to), "left_anti").drop("segment")


def indexed_keyword_search(segments: list[Segment], documents: DataFrame, query: str, limit: int, document_ids: DataFrame | None = None, removed: DataFrame | None = None) -> Found:
    """The rows of ``search.keyword_search``, in its order."""
    spark, terms = documents.sparkSession, query_terms(query)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, relative_path string, position int, text string, score int"
    live = active(documents, document_ids).select("doc_id", "relative_path")

    def scored(texts: DataFrame) -> DataFrame:
        hits = _standing(texts, removed).withColumn("score", keyword_score(F.col("text"), terms)).where("score > 0").drop("relative_path")
        return hits.join(live, "doc_id").select("doc_id", "relative_path", "position", "text", "score").orderBy(F.desc("score"), "relative_path", "position").limit(limit)

    if not terms or not segments or limit < 1:
        return Found(spark.createDataFrame([], schema))
    search = _Search(spark, segments, terms, lambda t, f: 1.0, False, id_type)
    place = lambda r: (r.relative_path or "", r.position)
    best, files, blocks = search.walk(scored, lambda r: (-r.score, *place(r)), lambda bound, first, last: bound > last.score or (bound == last.score and first < place(last)), limit)
    return Found(spark.createDataFrame(best, schema), files, blocks)


def indexed_page_search(segments: list[Segment], documents: DataFrame, query: str, conditions: list[Condition] | None = None, limit: int = 10, document_ids: DataFrame | None = None, removed: DataFrame | None = None) -> Found:
    """The rows of ``pages.page_search`` over pages that are indexed with their number as position."""
    spark, terms, limit = documents.sparkSession, page_terms(query), max(limit, 1)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def scored(texts: DataFrame) -> DataFrame:
        pages = _standing(texts, removed).select("doc_id", F.col("position").alias("page_no"), F.col("text").alias("markdown"), "heading")
        return page_search(pages, documents, query, conditions, limit, document_ids)

    empty = spark.createDataFrame([], TEXTS.format(id=id_type)).withColumn("segment", F.lit(0))
    schema = scored(empty).schema
    if not terms or not segments:
        return Found(spark.createDataFrame([], schema))
    search = _Search(spark, segments, terms, lambda t, f: (12.0 if t == 0 else 3.0) + 2.0 * f, True, id_type)
    best, files, blocks = search.walk(scored, lambda r: (-r.score, -r.match_count, r.original_filename.lower(), r.page_no, r.doc_id), lambda bound, first, last: bound >= last.semantic_score, limit)
    return Found(spark.createDataFrame(best, schema), files, blocks)

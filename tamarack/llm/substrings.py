"""Repeated passages, removed incrementally with a log-structured fingerprint index.

A window is 13 consecutive words; its fingerprint is a 64-bit hash of its words, and
16 more bits verify it. The index is a list of sorted immutable runs: a run has, for
each interval of fingerprints, the distinct windows of a batch in order. A new batch
is hashed, sorted into intervals and written as a run; interval by interval it is
merge-joined with each older run, and what a run has, key and check, is a repeat. When a
level has ``fan_in`` runs they are merged to one of the next level, so there
are few runs however many batches come, and a window is rewritten once a level.

Runs are tables bucketed by interval, so neither joins nor merges exchange a
run's rows; only the new batch is shuffled, once. A task keeps the smallest document of
each window that it sees and names the others as repeats on the spot, so a
window that very many documents share travels once from each task.

Batches come in the order of ids: documents of an earlier batch count as smaller. The
query cuts its table into ``BATCHES`` ranges of ids. Two different windows are
taken as equal with a chance of 2^-80 a pair.

Defined cases: null texts have no words; rows without an id keep all their words
and take none from others; rows of a batch that share an id are one document, and none
of them takes words from another; within one document nothing is removed; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WordHashes, discard, gram_hashes, map_frames, materialize, per_sorted_group, read, scratch, short_batches, shuffles_removed, words_of

WINDOW = 13
#: Windows of one interval of a run, about, and the bits of an interval's number at most.
INTERVAL_WINDOWS, MOST_BITS = 400_000, 20
#: Windows that a task gathers before it sends them on.
FLUSH = 500_000
#: Characters whose words are made at once.
SLICE = 1 << 19
#: Runs of a level that are merged; batches of the query.
FAN_IN, BATCHES = 3, 4
SECOND = 0xD6E8FEB86659FD93


def _planes(x: np.ndarray) -> bytes:
    """Byte planes: those that are constant cost nothing once compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes | None, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data or b"", np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(x: np.ndarray) -> bytes:
    """A sorted array of uint64 by its steps."""
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _unpack(data: bytes | None) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about SLICE characters: words take many times the memory of their text."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= SLICE or i == len(texts) - 1:
            yield begin, i + 1
            begin, held = i + 1, 0


def windows_of(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, checks and the text's number of all windows of all texts."""
    lists = [words_of(t) for t in texts]
    sizes = [len(w) for w in lists]
    h = np.fromiter(map(hashes.__getitem__, itertools.chain.from_iterable(lists)), np.uint64, sum(sizes))
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
    return gram_hashes(h, WINDOW)[inside], (gram_hashes(h, WINDOW, SECOND)[inside] >> np.uint64(48)).astype(np.uint16), owner[inside]


def _firsts(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct windows, the least document of each; documents and keys of windows that a smaller document has."""
    if not len(keys):
        return keys, checks, docs, docs, keys
    order = np.argsort(keys, kind="stable")
    keys, checks, docs = keys[order], checks[order], docs[order]
    same = keys[1:] == keys[:-1]
    if (same & (checks[1:] != checks[:-1])).any():  # windows that differ although their keys don't
        order = np.lexsort((checks, keys))
        keys, checks, docs = keys[order], checks[order], docs[order]
        same = (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])
    begin = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(docs, begin)
    late = docs > least[np.cumsum(np.r_[True, ~same]) - 1]
    return keys[begin], checks[begin], least, docs[late], keys[late]


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(interval, from, to) of the intervals that sorted keys fall in."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(part[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True))


_PACKED = "part int, kind int, keys binary, checks binary, docs binary"
_RUN = "part int, keys binary, checks binary, docs binary, late_docs binary, late_keys binary"


def _send(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, bits: int) -> pd.DataFrame:
    """Rows of windows by interval (kind 0), and of repeats by document, spread over the intervals (kind 1)."""
    keys, checks, docs, late_docs, late_keys = _firsts(keys, checks, docs)
    rows = [(part, 0, _pack(keys[a:b]), _planes(checks[a:b]), _planes(docs[a:b])) for part, a, b in _cuts(keys, bits)]
    spread = late_docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(spread, kind="stable")
    rows += [(part, 1, _planes(late_keys[order[a:b]]), None, _planes(late_docs[order[a:b]])) for part, a, b in _cuts(spread[order], bits)]
    return pd.DataFrame(rows, columns=["part", "kind", "keys", "checks", "docs"])


def _run_row(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """An interval of a run from what all tasks sent of it."""
    own, late = group[group.kind == 0], group[group.kind == 1]
    together = lambda frame, c, undo, kind: np.concatenate([np.empty(0, kind), *(undo(x) for x in frame[c])])
    docs_of, keys_of = lambda x: _unplanes(x, np.int64), lambda x: _unplanes(x, np.uint64)
    keys, checks, docs, more_docs, more_keys = _firsts(together(own, "keys", _unpack, np.uint64), together(own, "checks", lambda x: _unplanes(x, np.uint16), np.uint16), together(own, "docs", docs_of, np.int64))
    late_docs, late_keys = np.concatenate([together(late, "docs", docs_of, np.int64), more_docs]), np.concatenate([together(late, "keys", keys_of, np.uint64), more_keys])
    order = np.argsort(late_docs, kind="stable")
    return pd.DataFrame({"part": [key[0]], "keys": [_pack(keys)], "checks": [_planes(checks)], "docs": [_planes(docs)], "late_docs": [_planes(late_docs[order])], "late_keys": [_planes(late_keys[order])]})


def _had(keys: np.ndarray, checks: np.ndarray, old_keys: np.ndarray, old_checks: np.ndarray) -> np.ndarray:
    """Which of the sorted distinct windows are among the old ones, key and check."""
    at = np.searchsorted(old_keys, keys)
    known = np.r_[old_keys, np.uint64(0)][at] == keys
    known[at == len(old_keys)] = False
    out = known & (np.r_[old_checks, np.uint16(0)][at] == checks)
    for i in np.flatnonzero(known & ~out):  # an old window with this key and another check comes first
        j = at[i]
        while j < len(old_keys) and old_keys[j] == keys[i]:
            out[i] |= old_checks[j] == checks[i]
            j += 1
    return out


class FingerprintIndex:
    """Sorted immutable runs in one folder that driver and executors share.

    ``bits``: leading bits of a fingerprint that name its interval, the same for all
    runs. ``fan_in``: runs of one level that are merged to one of the next.
    """

    def __init__(self, spark: SparkSession, bits: int, fan_in: int = FAN_IN, folder: str | None = None):
        self.spark, self.bits, self.fan_in = spark, bits, fan_in
        self.folder = folder or scratch(spark)
        #: (level, table) of each run, oldest first.
        self.runs: list[tuple[int, str]] = []
        self.windows = 0

    @classmethod
    def sized_for(cls, docs: DataFrame, batches: int = 1, **more) -> FingerprintIndex:
        """An index whose intervals suit texts of this many bytes that come in so many batches."""
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return cls(docs.sparkSession, min(MOST_BITS, max(3, math.ceil(math.log2(max(1, total / 6.5 / batches / INTERVAL_WINDOWS))))), **more)

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _write(self, rows: DataFrame, level: int) -> str:
        """Rows of all intervals as the bucketed table of a new run."""
        table = f"tamarack_run_{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            rows.write.format("parquet").option("compression", "zstd").option("path", self._path(table)).bucketBy(1 << min(self.bits, 16), "part").saveAsTable(table)
        self.runs.append((level, table))
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        discard(self.spark, self._path(table))

    def drop(self) -> None:
        """Remove all runs."""
        for _, table in self.runs:
            self._drop(table)
        self.runs = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch (doc_id bigint, text) as a new run; doc_id, key of its windows that an earlier batch or a smaller document has."""
        bits = self.bits
        self._merge_full_levels()

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes, held, many = WordHashes(), [], 0
            for pdf in batches:
                texts, ids = pdf.text.tolist(), pdf.doc_id.to_numpy(np.int64)
                for a, b in slices(texts):
                    keys, checks, owner = windows_of(texts[a:b], hashes)
                    held.append((keys, checks, ids[a:b][owner]))
                    many += len(keys)
                    if many >= FLUSH:
                        yield _send(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)
                        held, many = [], 0
            if many:
                yield _send(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)

        packed = docs.where("doc_id is not null and text is not null").select("doc_id", "text").transform(map_frames, send, _PACKED)
        # every run has every interval, so that runs meet in inner joins
        every = self.spark.range(1 << bits).selectExpr("cast(id as int) part", "0 kind", "cast(null as binary) keys", "cast(null as binary) checks", "cast(null as binary) docs")
        older = [table for _, table in self.runs]
        new = self._write(per_sorted_group(packed.unionByName(every), ["part"], _run_row, _RUN), 0)
        return self._repeats(new, older)

    def _repeats(self, new: str, older: list[str]) -> DataFrame:
        def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for docs, keys in zip(pdf.late_docs, pdf.late_keys, strict=True):
                    yield pd.DataFrame({"doc_id": _unplanes(docs, np.int64), "key": _unplanes(keys, np.int64)})

        def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    keys = _unpack(row.keys)
                    had = _had(keys, _unplanes(row.checks, np.uint16), _unpack(row.old_keys), _unplanes(row.old_checks, np.uint16))
                    yield pd.DataFrame({"doc_id": _unplanes(row.docs, np.int64)[had], "key": keys[had].view(np.int64)})

        batch = self.spark.table(new)
        out = batch.select("late_docs", "late_keys").transform(map_frames, within, "doc_id bigint, key bigint")
        for table in older:
            old = self.spark.table(table).select("part", F.col("keys").alias("old_keys"), F.col("checks").alias("old_checks"))
            # buckets of equal number: neither side is exchanged
            out = out.unionByName(batch.select("part", "keys", "checks", "docs").hint("merge").join(old, "part").transform(map_frames, against, "doc_id bigint, key bigint"))
        return materialize(out, "repeats")

    def _merge_full_levels(self) -> None:
        for level in itertools.count():
            full = [table for at, table in self.runs if at == level]
            if len(full) >= self.fan_in:
                self.compact(full, level + 1)
            if all(at <= level for at, _ in self.runs):
                return

    def compact(self, tables: list[str] | None = None, level: int = 1) -> None:
        """Merge runs (all of them) into one, interval by interval."""
        tables = tables or [table for _, table in self.runs]
        names = [f"{c}_{k}" for k in range(len(tables)) for c in ("keys", "checks")]
        joined = None
        for k, table in enumerate(tables):
            run = self.spark.table(table).select("part", F.col("keys").alias(f"keys_{k}"), F.col("checks").alias(f"checks_{k}"))
            joined = run if joined is None else joined.hint("merge").join(run, "part")

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, *cells in pdf[["part", *names]].itertuples(index=False, name=None):
                    keys, checks = np.concatenate([_unpack(x) for x in cells[::2]]), np.concatenate([_unplanes(x, np.uint16) for x in cells[1::2]])
                    keys, checks, _, _, _ = _firsts(keys, checks, np.zeros(len(keys), np.int64))
                    yield pd.DataFrame({"part": [part], "keys": [_pack(keys)], "checks": [_planes(checks)]})

        self.runs = [(at, table) for at, table in self.runs if table not in tables]
        self._write(joined.transform(map_frames, merge, "part int, keys binary, checks binary"), level)
        for table in tables:
            self._drop(table)


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, kept (words joined by a space), n_words, n_removed, of each row of the batch ``docs``.

    Removes each word that a window covers which an earlier batch of ``index`` has,
    or a document of the batch with a smaller id. The batch is added to the index.
    """
    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    index = index or FingerprintIndex.sized_for(texts)
    found = index.add(texts).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            kept, counts, removed = [], [], []
            for text, keys in zip(pdf.text, pdf["keys"], strict=True):
                words = words_of(text if isinstance(text, str) else None)
                n = len(words)
                if keys is not None and n >= WINDOW:
                    gone = np.zeros(n + 1, np.int32)
                    at = np.flatnonzero(np.isin(gram_hashes(hashes.of(words), WINDOW), np.asarray(keys, np.int64).view(np.uint64)))
                    gone[at] += 1
                    np.subtract.at(gone, at + WINDOW, 1)
                    words = list(itertools.compress(words, np.cumsum(gone[:n]) <= 0))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                counts.append(n)
                removed.append(n - len(words))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "kept": kept, "n_words": counts, "n_removed": removed})

    return texts.join(found, "doc_id", "left").transform(map_frames, strip, "doc_id bigint, kept string, n_words bigint, n_removed bigint")


def id_ranges(docs: DataFrame, many: int, id_col: str = "doc_id") -> list[DataFrame]:
    """The rows of ``docs`` in ranges of ids, ascending; rows without an id are in the first."""
    edges = sorted({math.ceil(x) for x in docs.select(F.col(id_col).cast("double").alias("i")).approxQuantile("i", [k / many for k in range(1, many)], 0.01) or []})
    key = F.col(id_col)
    if not edges:
        return [docs]
    inner = [docs.where((key >= a) & (key < b)) for a, b in itertools.pairwise(edges)]
    return [docs.where(key.isNull() | (key < edges[0])), *inner, docs.where(key >= edges[-1])]


def op10_fingerprint_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 13-word windows that start in a smaller document too, in batches of ascending ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = FingerprintIndex.sized_for(docs, BATCHES)
    out = None
    try:
        for batch in id_ranges(docs, BATCHES):
            digest = remove_repeats(batch, index).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
            part = materialize(digest, "batch")
            out = part if out is None else out.unionByName(part)
    finally:  # the runs are tables of the catalog, which outlives the session
        index.drop()
    return out


#: The same in DuckDB's SQL.
OP10_SQL = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS x FROM g),
m AS (SELECT x, min(doc_id) AS first FROM h GROUP BY x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN m USING (x) WHERE first < doc_id),
l AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]), ' ') END) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id)"""

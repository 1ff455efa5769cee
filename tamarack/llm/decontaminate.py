"""Benchmark decontamination by latent semantic retrieval.

All documents are cut into passages of 48 words. Their TF-IDF rows, on hashed
words, have their leading singular vectors computed by a randomised method that
passes over the rows once: each task sums A'(A Omega) over its passages, the sums
are added up by rows of that matrix, and Nystrom's formula gives vectors and
values. In the latent space, scaled to equal variance in every direction, the
cosine of every overlapping passage with every benchmark item is computed;
passages of 32 words serve short items and of 48 words longer ones, at steps of 16.
Items longer than a passage are cut into even pieces of at most 32 words, which some
passage holds whole wherever they stand; each piece is looked for on its own, and
what it finds is a candidate of its item.

The cosine of a passage with what it holds of an item falls with the square root of
the item's share of the passage, so each piece has its own threshold, a little below
that of a paraphrase that keeps PARAPHRASE of it and never above COSINE. Items of at
most ``TINY`` words are also candidates, whatever the cosine, where a passage holds
PARAPHRASE of their words; what only this finds must stand together, in a run of
words that is longer than the item by at most a quarter.

A region of passages above the cosine's threshold, in runs of at most thrice the
item's words and a passage, is confirmed by the longest common subsequence of its
words and the item's. A share of ``COPY`` of the item's
words is a copy; a share of ``PARAPHRASE`` counts if also the item's answer (its
last sentence) is found, by a share of ``ANSWER`` of its words in order.

Items travel to all tasks in blocks of about ``ITEMS`` pieces (a matrix of ITEMS x
RANK numbers and their words), one block after another, however many there are.

Defined cases: null and blank texts match nothing, items without words neither;
texts shorter than a passage are one; equal texts match alike; empty tables give no
rows; rows without an id are compared and have a null id; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WordHashes, finished, map_frames, materialize, read, short_batches
from .latent import orthonormal

FEATURE_BITS, RANK, OVERSAMPLE = 13, 64, 8
FEATURES = 1 << FEATURE_BITS
STEP, SHORT_BLOCKS, LONG_BLOCKS, SHORT_ITEM, PIECE, TINY = 16, 2, 3, 24, 32, 16
COSINE, COPY, PARAPHRASE, ANSWER, SHARED = 0.4, 0.8, 0.5, 0.8, 0.25
ITEMS = 4096
#: Places of a feature in a part of the passages from which they are summed by a product of matrices.
OFTEN = 64
#: Batches whose words are coded together.
TOGETHER = 4
#: Singular values, as a share of the largest, below which a direction is taken for rounding.
LEAST_VALUE = 3e-3
_EDGES = b".,;:!?\"'()[]{}<>|#$%&*+-=/\\_~^`"


class Cores(WordHashes):
    """word -> 64-bit hash of its letters' core in lower case; its leading bits are its feature."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower().strip(_EDGES) or word, 11)
        return value

    def of_text(self, text) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _laid_out(features) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts in blocks of STEP words, two empty blocks after each text; each text's first block."""
    coded_ = [np.frombuffer(f, "<u2") for f in features]
    blocks = np.array([-(-len(f) // STEP) + (LONG_BLOCKS - 1 if len(f) else 0) for f in coded_], np.int64)
    begin = np.r_[0, np.cumsum(blocks)]
    grid = np.full(int(begin[-1]) * STEP, FEATURES, np.uint16)  # FEATURES: no word
    for f, b in zip(coded_, begin[:-1], strict=True):
        grid[b * STEP : b * STEP + len(f)] = f
    return grid.reshape(-1, STEP), begin


def _starts(begin: np.ndarray, many: int) -> np.ndarray:
    """First blocks of passages of ``many`` blocks: those that end within the text, or a short text's first."""
    words = np.maximum(np.diff(begin) - (LONG_BLOCKS - 1), 0)
    count = np.where(words > 0, np.maximum(words - many + 1, 1), 0)
    owner = np.repeat(np.arange(len(count)), count)
    return begin[:-1][owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _block_sums(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows of each block's words; the table's last row is zero."""
    out = np.zeros((len(grid), table.shape[1]), np.float32)
    held = np.empty((2048, table.shape[1]), np.float32)
    for at in range(0, len(grid), 2048):  # a column of words at a time: sums stay in the cache
        part = out[at : at + 2048]
        for s in range(STEP):
            np.take(table, grid[at : at + 2048, s], axis=0, out=held[: len(part)], mode="clip")
            part += held[: len(part)]
    return out


def _passages(grid: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Passages that don't overlap: rows of LONG_BLOCKS blocks (the empty blocks after a text complete its last one)."""
    rows = [grid[a + LONG_BLOCKS * k : a + LONG_BLOCKS * (k + 1)].ravel() for a, b in zip(begin[:-1], begin[1:], strict=True) for k in range((b - a) // LONG_BLOCKS)]
    return np.array(rows, np.uint16).reshape(-1, LONG_BLOCKS * STEP)


def _sums_by_feature(rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, for each the sum of y's rows over its places in ``rows``).

    Features of many places are a matrix of counts times y; of the others all first
    places are added, then all second ones: sums grow in place, most places first.
    """
    m, width = rows.shape
    order = np.argsort(rows.ravel(), kind="stable")
    f, who = rows.ravel()[order], order // width
    heads = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    counts = np.diff(np.r_[heads, len(f)])
    by = np.argsort(-counts, kind="stable")
    often = int((counts > OFTEN).sum())
    out = np.zeros((len(heads), y.shape[1]), np.float32)
    if often:
        number = np.full(len(heads), -1)
        number[by[:often]] = np.arange(often)
        number = np.repeat(number, counts)
        here = number >= 0
        out[:often] = np.bincount(number[here] * m + who[here], minlength=often * m).reshape(often, m).astype(np.float32) @ y
    first, least = heads[by[often:]], -counts[by[often:]]
    for k in range(int(-least[0]) if len(least) else 0):
        n = int(np.searchsorted(least, -k, "left"))  # those with more than k places
        out[often : often + n] += y[who[first[:n] + k]]
    return f[heads[by]], out


def coded(docs: DataFrame, id_col: str) -> DataFrame:
    """id, text, features (little-endian uint16, one for each word): words are hashed once for all passes, those of a batch once each."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, text string, features binary"
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores = Cores()
        for some in itertools.batched(batches, TOGETHER):  # the more texts, the fewer distinct words each adds
            words = [pc.ascii_split_whitespace(pc.fill_null(batch.column(1), "")) for batch in some]
            encoded = pa.chunked_array([w.flatten() for w in words]).dictionary_encode()
            distinct = encoded.chunk(0).dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            feature = _feature(cores.of(distinct)).astype("<u2")
            real = distinct != b""  # a text's ends can give empty words
            for batch, split, chunk in zip(some, words, encoded.chunks, strict=True):
                numbers = chunk.indices.to_numpy()
                kept = real[numbers]
                ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]]
                data = [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(feature[numbers[kept]].tobytes())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.BinaryArray.from_buffers(pa.binary(), len(split), data)], schema=fields)

    return docs.select(id_col, "text").mapInArrow(run, schema)


def passage_frequencies(table: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that have each feature, passages), over all rows of a coded table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(FEATURES + 1, np.int64)
        for pdf in batches:
            grid, begin = _laid_out(pdf.features)
            rows = np.sort(_passages(grid, begin), axis=1)
            fresh = np.ones(rows.shape, bool)
            fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
            df += np.bincount(rows[fresh & (rows < FEATURES)], minlength=FEATURES + 1)
            df[FEATURES] += len(rows)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": at, "n": df[at]})

    out = np.zeros(FEATURES + 1, np.int64)
    for r in table.select("features").transform(map_frames, run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out[:FEATURES], int(out[FEATURES])


def _extended(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)]).astype(np.float32)


def latent_space(table: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Matrix from weighted words to the latent space, each direction scaled by its singular value."""
    width = rank + OVERSAMPLE
    omega = orthonormal(np.random.default_rng(seed).standard_normal((FEATURES, width)))
    weight = _extended(idf[:, None])[:, 0]
    start = _extended(omega * idf[:, None])
    piece = 512  # rows of the sum that travel together

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, width), np.float32)
        for pdf in batches:
            rows = _passages(*_laid_out(pdf.features))
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                flat = part.ravel()
                # squares of the row's norm: words that repeat count with their sum
                y = sum(_block_sums(part[:, a : a + STEP], start) for a in range(0, part.shape[1], STEP))
                same = np.sort(part, axis=1)
                first = np.ones(same.shape, bool)
                first[:, 1:] = same[:, 1:] != same[:, :-1]
                runs = np.flatnonzero(first.ravel())
                counts = np.diff(np.r_[runs, flat.size])
                squares = np.bincount(runs // part.shape[1], (counts * weight[same.ravel()[runs]]) ** 2, len(part))
                y /= np.maximum(squares, 1e-12)[:, None]
                found, sums = _sums_by_feature(part, y.astype(np.float32))
                total[found] += sums
        total = total[:FEATURES] * idf[:, None]
        yield pd.DataFrame({"piece": range(FEATURES // piece), "data": [total[i : i + piece].astype("<f4").tobytes() for i in range(0, FEATURES, piece)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for number, data in zip(pdf.piece, pdf.data, strict=True):
                x = np.frombuffer(data, "<f4" if len(data) == 4 * piece * width else "<f8").astype(np.float64)
                sums[number] = sums.get(number, 0) + x
        yield pd.DataFrame({"piece": list(sums), "data": [x.tobytes() for x in sums.values()]})

    schema = "piece int, data binary"
    sums = table.select("features").transform(map_frames, run, schema).repartition("piece").transform(map_frames, add, schema).collect()
    gram = np.zeros((FEATURES, width))
    for r in sums:
        gram[r["piece"] * piece : (r["piece"] + 1) * piece] += np.frombuffer(r["data"], "<f8").reshape(piece, width)
    # Nystrom: A'A is close to G (Omega' G)^-1 G'
    nudge = 1e-7 * max(np.linalg.norm(gram), 1e-12)
    shifted = gram + nudge * omega
    core = omega.T.astype(np.float64) @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, nudge))
    u, s, _ = np.linalg.svd(shifted @ half @ vectors.T, full_matrices=False)
    # directions that a small table doesn't have are rounding errors: scaled up they would drown the rest
    real = s[:rank] > LEAST_VALUE * max(s[0], 1e-12)
    return np.where(real, u[:, :rank] / np.where(real, s[:rank], 1), 0).astype(np.float32)


def answer_of(text: str) -> str:
    """The last sentence, of at least three words if there is one."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p.strip()]
    return next((p for p in reversed(parts) if len(p.split()) >= 3), parts[-1] if parts else "")


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            v = (v + (v & m)) | (v & ~m)
    return length - (v & full).bit_count()


def _pieces(length: int) -> list[tuple[int, int]]:
    """Bounds of an item's pieces: itself, or even parts of at most PIECE words if it is longer than a passage."""
    many = 1 if length <= LONG_BLOCKS * STEP else -(-length // PIECE)
    edges = [length * k // many for k in range(many + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


class Items:
    """A block of benchmark items: words, answers, and latent vectors of unit length of their pieces."""

    def __init__(self, rows: list[tuple[int, str]], to_latent: np.ndarray, idf: np.ndarray):
        cores = Cores()
        self.ids, self.words, self.answers, vectors, cells, shares, owner = [], [], [], [], [], [], []
        for key, text in rows:
            h = cores.of_text(text)
            if not len(h):
                continue
            for a, b in _pieces(len(h)):
                f = _feature(h[a:b])
                x = to_latent[f].sum(axis=0)
                held = np.unique(f)
                cells.append(len(vectors) * (FEATURES + 1) + held)
                shares.append(idf[held] / idf[held].sum())
                vectors.append(x / max(np.linalg.norm(x), 1e-12))
                owner.append(len(self.ids))
            self.ids.append(key)
            self.words.append((_masks(h), len(h)))
            a = cores.of_text(answer_of(text))
            self.answers.append((_masks(a), len(a)))
        #: The item of each piece.
        self.owner = np.array(owner, np.int64)
        self.first = np.searchsorted(self.owner, np.arange(len(self.ids)))
        lengths = np.array([n for _, n in self.words], np.int64)[self.owner]
        self.groups = [(SHORT_BLOCKS, np.flatnonzero(lengths <= SHORT_ITEM)), (LONG_BLOCKS, np.flatnonzero(lengths > SHORT_ITEM))]
        self.vectors = np.array(vectors, np.float32).reshape(-1, to_latent.shape[1])
        #: What each feature is of a piece's weight, by piece and feature; only those that a piece has.
        self.cells = np.concatenate([np.empty(0, np.int64), *cells, [np.iinfo(np.int64).max]])
        self.shares = np.concatenate([np.empty(0, np.float32), *shares, [0]]).astype(np.float32)
        #: Lowest cosine of a passage that counts, for each piece.
        pieces = np.array([b - a for _, n in self.words for a, b in _pieces(n)], np.float64)
        blocks = np.where(lengths <= SHORT_ITEM, SHORT_BLOCKS, LONG_BLOCKS)
        self.least = np.minimum(COSINE, 0.9 * PARAPHRASE * np.sqrt(pieces / (STEP * blocks))).astype(np.float32)
        self.tiny = np.flatnonzero(np.array([n for _, n in self.words], np.int64) <= TINY)
        #: How many of a tiny item's words have each feature, tiny items in the order of ``tiny``.
        rows = [(f, k, 1) for k, j in enumerate(self.tiny) for w, m in self.words[j][0].items() for f in _feature(np.array([w], np.uint64)) for _ in range(m.bit_count())]
        f, k, one = np.array(rows, np.int64).reshape(-1, 3).T
        order = np.argsort(f, kind="stable")
        self.posted, self.posting = np.searchsorted(f[order], np.arange(FEATURES + 2)), k[order]
        self.of_tiny = np.append(np.diff(self.posted)[:FEATURES] > 0, False)
        #: How often a feature is in one tiny item at most.
        self.most = np.zeros(FEATURES + 1, np.int64)
        pairs, times = np.unique(f * max(1, len(self.tiny)) + k, return_counts=True)
        np.maximum.at(self.most, pairs // max(1, len(self.tiny)), times)

    @functools.cached_property
    def has(self) -> np.ndarray:
        """Whether a piece has a feature, by piece and feature; made by the task, not sent to it."""
        out = np.zeros(len(self.owner) * (FEATURES + 1), bool)
        out[self.cells[:-1]] = True
        return out

    def candidates(self, grid: np.ndarray, begin: np.ndarray, sums: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, item, cosine) of passages, named by their first block, that are close to a piece of an item and share words with it.

        No piece is longer than a passage, so one passage can hold all or most of it; of
        the pieces of an item that a text holds PARAPHRASE of, one at least has as large a
        part of its words there. Those words are lost to the search if they weigh less than
        SHARED of the piece (very frequent ones only) or stand so far apart that each passage
        has less; tests hold what is found against a comparison of everything.
        """
        found = []
        for many, which in self.groups:
            if not which.size:
                continue
            starts = _starts(begin, many)
            vectors = np.ascontiguousarray(self.vectors[which].T)
            for at in range(0, len(starts), 4096):
                first = starts[at : at + 4096]
                x = sum(sums[first + k] for k in range(many))
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                c = x @ vectors
                hit = np.flatnonzero(c >= np.minimum(self.least[which], cosine))
                i, j = hit // c.shape[1], hit % c.shape[1]
                for a in range(0, len(i), 16_384):
                    b, it = first[i[a : a + 16_384]], which[j[a : a + 16_384]]
                    places, of = np.unique(b, return_inverse=True)  # a passage's words are sorted once for all its pieces
                    words = np.sort(np.concatenate([grid[places + k] for k in range(many)], axis=1), axis=1)
                    words[:, 1:][words[:, 1:] == words[:, :-1]] = FEATURES  # no piece has it
                    wanted = np.take(words.astype(np.int64), of, axis=0)
                    wanted += it[:, None] * (FEATURES + 1)
                    held = np.flatnonzero(np.take(self.has, wanted))
                    weight = np.zeros(wanted.shape, np.float32)
                    weight.ravel()[held] = self.shares[np.searchsorted(self.cells, wanted.ravel()[held])]
                    keep = weight.sum(axis=1) >= SHARED
                    found.append((b[keep], self.owner[it[keep]], c.ravel()[hit[a : a + 16_384]][keep]))
        return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))  # type: ignore[return-value]


    def tiny_candidates(self, grid: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) of passages that hold at least PARAPHRASE of a tiny item's words."""
        if not self.tiny.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts, found = _starts(begin, SHORT_BLOCKS), []
        need = PARAPHRASE * np.array([self.words[j][1] for j in self.tiny])
        for at in range(0, len(starts), 1024):
            first = starts[at : at + 1024]
            words = np.sort(np.concatenate([grid[first + k] for k in range(SHORT_BLOCKS)], axis=1), axis=1)
            # only words of tiny items, and only passages with as many of them as the shortest needs
            fresh = self.of_tiny[words]
            fresh[:, 1:] &= words[:, 1:] != words[:, :-1]
            enough = np.flatnonzero((fresh * self.most[words]).sum(axis=1) >= need.min())
            first, words, fresh = first[enough], words[enough], fresh[enough]
            i, w = np.nonzero(fresh)[0], words[fresh].astype(np.int64)
            n = self.posted[w + 1] - self.posted[w]
            item = self.posting[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.posted[w], n)]
            held = np.bincount(np.repeat(i, n) * len(need) + item, minlength=len(first) * len(need)).reshape(len(first), len(need))
            i, k = np.nonzero(held >= need)
            found.append((first[i], self.tiny[k]))
        return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))  # type: ignore[return-value]


def regions(words: np.ndarray, start: int, stop: int, length: int) -> Iterator[list[int]]:
    """Runs of words between two places that are no longer than thrice the item and a passage; what is within twice the item's words and a passage lies within one."""
    span = 3 * length + LONG_BLOCKS * STEP
    stop = min(stop, len(words))
    for at in range(start, max(stop - span + length, start + 1), length):
        yield words[at : min(at + span, stop)].tolist()


def together(masks: dict[int, int], length: int, words: list[int]) -> tuple[int, int]:
    """Most of the item's words in order in a run of at most a quarter more words than it has, and the run's start."""
    span = length + length // 4
    return max(((common_subsequence(masks, length, words[i : i + span]), -i) for i, w in enumerate(words) if w in masks), default=(0, 0))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """doc id, item id, cosine, common (words in order), share, answer_share: confirmed matches, one a pair."""
    spark = docs.sparkSession
    short_batches(spark)
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, cosine double, common int, share double, answer_share double"
    items = benchmark.where(F.col("text").isNotNull()).select(item_col, "text").distinct()
    # pieces, not items, are what a block may hold ITEMS of
    pieces = items.agg(F.sum(F.ceil(F.size(F.split("text", r"\s+")) / PIECE))).first()[0] or 0
    blocks = -(-int(pieces) // ITEMS)
    if not blocks:
        return spark.createDataFrame([], schema)
    features = materialize(coded(docs, id_col), "features")
    df, passages = passage_frequencies(features)
    idf = (np.log((1 + passages) / (1 + df)) + 1).astype(np.float32)
    to_latent = latent_space(features, idf) * idf[:, None]
    table = _extended(to_latent)

    def searching(block: Items):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cores = Cores()
            for pdf in batches:
                grid, begin = _laid_out(pdf.features)
                sums = _block_sums(grid, table)
                where, item, cosine = block.candidates(grid, begin, sums)
                hashes: dict[int, np.ndarray] = {}
                texts = pdf.text.array
                doc = np.searchsorted(begin, where, "right") - 1
                order = np.lexsort((where, item, doc))
                where, item, cosine, doc = where[order], item[order], cosine[order], doc[order]
                cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (where[1:] > where[:-1] + LONG_BLOCKS)]) if len(doc) else np.empty(0, np.int64)
                best: dict[tuple[int, int], tuple] = {}
                for a, b in zip(cut, np.r_[cut, len(doc)][1:], strict=True):
                    d, j = int(doc[a]), int(item[a])
                    masks, length = block.words[j]
                    first = (int(where[a]) - int(begin[d])) * STEP
                    last = (int(where[b - 1]) - int(begin[d]) + LONG_BLOCKS) * STEP
                    if d not in hashes:  # words are needed of few texts
                        hashes[d] = cores.of_text(texts[d])
                    for region in regions(hashes[d], max(0, first - length), last + length, length):
                        if sum(w in masks for w in region) < PARAPHRASE * length:
                            continue
                        common = common_subsequence(masks, length, region)
                        if common < PARAPHRASE * length:
                            continue
                        answer, size = block.answers[j]
                        answered = common_subsequence(answer, size, region) / size if size else 0.0
                        if common >= COPY * length or answered >= ANSWER:
                            row = (common, float(cosine[a:b].max()), answered)
                            best[d, j] = max(best.get((d, j), row), row)
                where, item = block.tiny_candidates(grid, begin)
                doc = np.searchsorted(begin, where, "right") - 1
                for w, j, d in zip(where.tolist(), item.tolist(), doc.tolist(), strict=True):
                    masks, length = block.words[j]
                    if (d, j) in best and best[d, j][0] == length:
                        continue
                    first = (w - int(begin[d])) * STEP
                    if d not in hashes:
                        hashes[d] = cores.of_text(texts[d])
                    region = hashes[d][first : first + SHORT_BLOCKS * STEP].tolist()
                    common, start = together(masks, length, region)
                    if common < PARAPHRASE * length:
                        continue
                    answer, size = block.answers[j]
                    near = region[-start : -start + length + length // 4]
                    answered = common_subsequence(answer, size, near) / size if size else 0.0
                    if common >= COPY * length or answered >= ANSWER:
                        x = sums[w : w + SHORT_BLOCKS].sum(axis=0)
                        row = (common, float(x @ block.vectors[block.first[j]] / max(np.linalg.norm(x), 1e-12)), answered)
                        best[d, j] = max(best.get((d, j), row), row)
                if best:
                    ids = pdf[id_col].array
                    yield pd.DataFrame([(ids[d], block.ids[j], round(c, 6), n, n / block.words[j][1], s) for (d, j), (n, c, s) in best.items()], columns=[id_col, item_col, "cosine", "common", "share", "answer_share"], dtype=object)

        return run

    out = None
    for b in range(blocks):
        # at most about ITEMS pieces of the benchmark at a time
        rows = sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64(item_col, "text"), F.lit(blocks)) == b).collect())
        part = features.transform(map_frames, searching(Items(rows, to_latent, idf)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that match an item; rows without an id stay.

    Ids found are a table, so what the search wrote is gone before texts are moved, and few ids move none.
    """
    found = finished(docs.sparkSession, lambda: matches(docs, benchmark, id_col).select(id_col).distinct(), "found")
    return docs.join(found, id_col, "left_anti").select(docs.columns)


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as a copy or a paraphrase: pairs (doc_id, item_id)."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

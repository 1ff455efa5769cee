"""Quality by nearest neighbours among labelled latent-semantic vectors.

Features are the letters' core of each word, the word's shape (its classes of
characters with its punctuation), and whether a text repeats itself: the share of
words that repeat the word before, and of words that are new. Document
frequencies are counted over all documents. Singular vectors of the labelled
sample's TF-IDF rows make the latent space; the sample's vectors are sent to all
tasks, the cosine with each of them is computed for every document, in blocks,
and the labels of the nearest vote with weights that grow with the cosine.

The sample has at most ``SAMPLE`` labelled documents, those first in the order of
a hash of the id, so what is sent to tasks is at most SAMPLE x RANK numbers.

Defined cases: null, empty or blank texts get the sample's share of label 1, and so
does every text if nothing is labelled (then 0.5); equal texts get equal scores; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_frames, read, short_batches
from .latent import document_frequencies, inverse_frequencies, right_singular_vectors, times, weighted
from .toxicity import held_out, labelled_sample

SAMPLE, RANK, NEIGHBOURS, SHARPNESS = 4096, 64, 25, 6
WORD_BITS, SHAPE_BITS = 13, 11
#: Shares of words that repeat the word before, and of words that are new to the text, past which a feature counts.
REPEATED, FRESH = (0.03, 0.1, 0.3, 0.6), (0.5, 0.3, 0.15, 0.05)
_REST = (1 << WORD_BITS) + (1 << SHAPE_BITS)
FEATURES = _REST + len(REPEATED) + len(FRESH)
_EDGES = ".,;:!?\"'()[]{}<>|#$%&*+-=/\\_~^`"
_CLASSES = (re.compile(r"[^\W\d_]*[a-zß-öø-ÿ]+[^\W\d_]*"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))
_RUNS = re.compile(r"(.)\1{3,}")


def shape(word: str, core: str | None = None) -> str:
    """Letters with a small one as a (Aa after a capital), without as A, digits as 0; the rest stays, repeats cut to 3."""
    core = word.strip(_EDGES) if core is None else core
    if core.isalpha():  # most words: letters between marks
        form = "A" if core.isupper() else "Aa" if core[0].isupper() else "a"
        more = len(word) - len(core)
        if not more:
            return form
        at = word.index(core)
        out = word[:at] + form + word[at + len(core) :]
        if more <= 3:
            return out
    else:
        out = _CLASSES[0].sub(lambda m: "Aa" if m[0][0].isupper() else "a", word)
        out = _CLASSES[1].sub(lambda m: m[0] if m[0] in ("a", "Aa") else "A", out)
        out = _CLASSES[2].sub("0", out)
    return _RUNS.sub(r"\1\1\1", out)[:12]


@functools.lru_cache(1 << 14)
def _shape_code(form: str) -> int:
    return zlib.crc32(form.encode("utf-8", "surrogatepass"), 6) >> (32 - SHAPE_BITS) << WORD_BITS


class _Codes(dict):
    """word -> number of its core and number of its shape, in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        core = word.strip(_EDGES)
        value = self[word] = zlib.crc32(core.lower().encode("utf-8", "surrogatepass"), 5) >> (32 - WORD_BITS) | _shape_code(shape(word, core))
        return value


def counter():
    codes = _Codes()

    def count(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if isinstance(text, str) else []
        both = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        core, form = both & ((1 << WORD_BITS) - 1), (both >> WORD_BITS) + (1 << WORD_BITS)
        if not len(words):
            return both, both
        if len(words) > 500:  # counting is cheaper than sorting
            n = np.bincount(np.concatenate([core, form]), minlength=_REST)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(np.concatenate([core, form]), return_counts=True)
        again, fresh = (both[1:] == both[:-1]).mean() if len(words) > 1 else 0.0, (found < 1 << WORD_BITS).sum() / len(words)
        # a text that passes a share has the feature as often as it has words
        passed = [again >= r for r in REPEATED] + [len(words) >= 20 and fresh <= f for f in FRESH]
        more = _REST + np.flatnonzero(passed)
        return np.r_[found, more], np.r_[n, np.full(len(more), len(words))]

    return count


class QualityModel:
    def __init__(self, idf: np.ndarray, basis: np.ndarray | None, vectors: np.ndarray | None, labels: np.ndarray, share: float):
        self.idf, self.basis, self.vectors, self.labels, self.share = idf, basis, vectors, labels, share

    def scores(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(counts), self.share)
        if self.basis is None:
            return out
        rows = weighted(counts, self.idf)
        latent = times(rows, self.basis)
        norm = np.linalg.norm(latent, axis=1)
        at = np.flatnonzero(norm > 1e-9)
        k = min(NEIGHBOURS, len(self.labels))
        for block in np.array_split(at, max(1, -(-len(at) // 256))):
            if not block.size:
                continue
            cosine = (latent[block] / norm[block, None]) @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** SHARPNESS
            out[block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, kept_out, most: int = SAMPLE) -> QualityModel:
    df, rows = document_frequencies(docs, "text", counter, FEATURES)
    idf = inverse_frequencies(df, rows)
    share = labels.where(~kept_out & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    if share is None:
        return QualityModel(idf, None, None, np.empty(0), 0.5)
    # as many of either label, so that the rarer one has neighbours everywhere
    sample = labelled_sample(docs, labels, label, kept_out, most // 2)
    count = counter()
    counted = [(count(t), y) for t, y in sample]
    counted = [(c, y) for c, y in counted if len(c[0])]
    y = np.array([y for _, y in counted], np.float32)
    if not len(y) or y.min() == y.max():
        return QualityModel(idf, None, None, y, float(share))
    sparse = weighted([c for c, _ in counted], idf)
    basis, _ = right_singular_vectors(sparse, FEATURES, min(RANK, len(y) - 1))
    latent = times(sparse, basis)
    norm = np.linalg.norm(latent, axis=1)
    return QualityModel(idf, basis, (latent / np.maximum(norm, 1e-9)[:, None]).astype(np.float32), y, float(share))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with ``score`` in place of the text."""
    rest = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter()
        for pdf in batches:
            yield pdf[rest].assign(score=model.scores([count(t) for t in pdf[text_col]]).astype(np.float64))

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", score double"
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`")).transform(map_frames, run, schema)


def op5_latent_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from those whose id's checksum mod 3 is not 1."""
    short_batches(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit_quality(docs, labels, "quality", out)
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

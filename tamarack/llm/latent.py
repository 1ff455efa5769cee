"""TF-IDF on hashed features and randomised singular vectors, in numpy.

Document frequencies are counted over all rows, as sums by feature; only sums come
to the driver, and there are at most ``FEATURES`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import map_frames

#: A text to the numbers of its features and their counts; made once for each task.
Counter = Callable[[], Callable[[str | None], tuple[np.ndarray, np.ndarray]]]


def document_frequencies(docs: DataFrame, text_col: str, counter: Counter, features: int) -> tuple[np.ndarray, int]:
    """(how many rows have each feature, how many have any), over all rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, df = counter(), np.zeros(features + 1, np.int64)
        for pdf in batches:
            for text in pdf[text_col]:
                found, _ = count(text)
                df[found] += 1
                df[features] += len(found) > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": at, "n": df[at]})

    sums = docs.select(text_col).transform(map_frames, run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(features + 1, np.int64)
    for r in sums:
        out[r["feature"]] = r["n"]
    return out[:features], int(out[features])


def inverse_frequencies(df: np.ndarray, rows: int) -> np.ndarray:
    return np.log((1 + rows) / (1 + df)).astype(np.float32) + np.float32(1)


def weighted(counts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of unit length: features, weights, and where each row begins."""
    sizes = np.array([len(f) for f, _ in counts], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.float32), np.r_[0, np.cumsum(sizes)]
    features = np.concatenate([f for f, _ in counts])
    value = (1 + np.log(np.concatenate([c for _, c in counts]))).astype(np.float32) * idf[features]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    norm = np.sqrt(np.bincount(owner, value * value, len(sizes)))
    return features, (value / norm[owner]).astype(np.float32), np.r_[0, np.cumsum(sizes)]


def times(rows: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray, part: int = 400) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    features, value, begin = rows
    out = np.zeros((len(begin) - 1, dense.shape[1]), np.float32)
    for at in range(0, len(out), part):
        edges = begin[at : at + part + 1]
        a, b = edges[0], edges[-1]
        full = np.flatnonzero(np.diff(edges))
        if full.size:
            out[at + full] = np.add.reduceat(dense[features[a:b]] * value[a:b, None], edges[full] - a, axis=0)
    return out


def transposed_times(rows: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray, features_total: int, part: int = 400) -> np.ndarray:
    """The transpose of sparse rows times a dense matrix."""
    features, value, begin = rows
    out = np.zeros((features_total, dense.shape[1]), np.float32)
    for at in range(0, len(begin) - 1, part):
        edges = begin[at : at + part + 1]
        a, b = edges[0], edges[-1]
        if a == b:
            continue
        owner = np.repeat(np.arange(at, at + len(edges) - 1), np.diff(edges))
        order = np.argsort(features[a:b], kind="stable")
        f = features[a:b][order]
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        out[f[first]] += np.add.reduceat(dense[owner[order]] * value[a:b][order, None], first, axis=0)
    return out


def orthonormal(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x.astype(np.float64))[0].astype(np.float32)


def right_singular_vectors(rows: tuple[np.ndarray, np.ndarray, np.ndarray], features_total: int, rank: int, power: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(V, singular values) of rank ``rank``, by a randomised range finder with power steps."""
    q = orthonormal(np.random.default_rng(seed).standard_normal((features_total, rank + 8)))
    for _ in range(power):
        q = orthonormal(transposed_times(rows, times(rows, q), features_total))
    y = times(rows, q).astype(np.float64)
    values, vectors = np.linalg.eigh(y.T @ y)
    order = np.argsort(values)[::-1][:rank]
    return (q @ vectors[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0)).astype(np.float32)

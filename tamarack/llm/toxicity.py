"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a hashed embedding of its letters' core joined with the sum (over
the root of their number) of embeddings of its hashed runs of 3 and 5 bytes, so that
words the sample didn't have still say something. Embeddings start with the evidence
that counts of the sample give, beyond what chance would, and at random in the rest. Words over ``PIECE`` bytes, as in texts without spaces, enter as pieces of
that size that overlap by half. Two GRUs read windows of 32 words that overlap by half, attention pools
their states, and a logistic unit scores the window; a document's score is
calibrated from its highest window, on labelled documents that weren't trained on.
Network and training are numpy.

Labels are for documents, not windows, so training alternates: the highest window
of each document stands for it, at first by the evidence of its words, then by the
network itself; clean documents are thus learnt at their worst.

The fit takes at most ``SAMPLE`` labelled documents of each label, those first in
the order of a hash of the id, and at most ``SAMPLE_BYTES`` of their texts;
everything is scored.

Defined cases: null, empty or blank texts get the calibrated score of the
sample's share of label 1; texts shorter than a window are padded and the padding
gets no attention; equal texts get equal scores; an empty table gives no rows;
without both labels in the sample every score is 0; an id that has both labels has
none; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import lower_words_of, map_frames, read, short_batches

#: Labelled documents of each label that a fit takes at most.
SAMPLE = 1500
#: Bytes of their texts.
SAMPLE_BYTES = 16 << 20
WINDOW, STRIDE = 32, 16
#: Bytes of a word that enter as one input.
PIECE = 60
GRAM_SIZES, GRAM_BITS = (3, 5), 15
WORDS, GRAMS, DIM, HIDDEN, ATTENTION = 1 << 15, 1 << GRAM_BITS, 8, 8, 8
EPOCHS, BATCH, RATE = 10, 256, 0.01
#: Steps that a small sample gets at least, in up to MOST_EPOCHS passes of smaller batches.
LEAST_STEPS, MOST_EPOCHS = 160, 40
#: Share of a word's inputs that a step of the fit leaves out, and how fast embeddings shrink.
DROPPED, DECAY = 0.5, 0.3
#: One of so many documents of a label calibrates, if the label has LEAST_APART.
APART, LEAST_APART = 5, 20
#: Starts of the network.
SEEDS = (7, 19, 31)
#: Bound of what a word says before training.
MOST_EVIDENCE = 3.0
_EDGES = b".,;:!?\"'()[]{}<>|#$%&*+-=/\\_~^`"


def held_out(id_column, folds: int = 5, fold: int = 0):
    """Whether crc32(id as text) mod folds is ``fold``."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, kept_out, most: int, id_col: str = "doc_id", most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` documents and ``most_bytes`` bytes of text of each label, first by a hash of the id; ``kept_out`` rows never.

    An id with both labels has none; of rows that share an id one is taken, with the
    least text. Texts of over a 64th of ``most_bytes`` aren't sampled.
    """
    usable = labels.where(~kept_out & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias(label), F.max(label).alias("other")).where(F.col(label) == F.col("other"))
    chosen = [usable.where(F.col(label) == v).orderBy(F.xxhash64(id_col), id_col).limit(most).select(id_col, label) for v in (0, 1)]
    # 2 * most rows of two numbers: small by its parameter
    rows = docs.select(id_col, "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), id_col).groupBy(id_col, label).agg(F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    # the window sees at most ``most`` rows
    first = Window.partitionBy(label).orderBy(F.xxhash64(id_col), id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = rows.where(size <= most_bytes // 64).withColumn("upto", F.sum(size).over(first)).where(F.col("upto") <= most_bytes).select(F.col(id_col).alias("i"), "text", F.col(label).alias("label")).collect()
    return [(r["text"] or "", int(r["label"])) for r in sorted(taken, key=lambda r: r["i"])]


def _inputs_of(text: str | None) -> list[bytes]:
    """The words of a text, with overlapping pieces in place of very long ones."""
    words = lower_words_of(text)
    if not words or max(map(len, words)) <= PIECE:
        return words
    return [p for w in words for p in ([w] if len(w) <= PIECE else [w[at : at + PIECE] for at in [*range(0, len(w) - PIECE, PIECE // 2), len(w) - PIECE]])]


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of 3 and of 5 bytes of ^word$ for each word, joined, and where each word's begin."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words) + bytes(4), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    room = np.repeat(ends, sizes) - np.arange(n)
    code, codes = np.zeros(n, np.uint32), []
    for k in range(5):
        code = (code ^ data[k : k + n]) * np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        if k + 1 in GRAM_SIZES:
            codes.append(((code + np.uint32(k)) * np.uint32(2246822507) >> np.uint32(32 - GRAM_BITS)).astype(np.uint16))
    fits = np.stack([room >= k for k in GRAM_SIZES], axis=1)
    lengths = np.add.reduceat(fits.sum(axis=1), np.r_[0, ends[:-1]])
    return np.stack(codes, axis=1)[fits], np.r_[0, np.cumsum(lengths)[:-1]]


def _all_grams(words: list[bytes], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """_grams of very many words, a part of them at a time."""
    found = [_grams(words[at : at + part]) for at in range(0, len(words), part)]
    before = np.cumsum([0] + [len(codes) for codes, _ in found])
    return np.concatenate([codes for codes, _ in found]), np.concatenate([starts + n for (_, starts), n in zip(found, before[:-1], strict=True)])


def _word_codes(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w.strip(_EDGES) or w) % WORDS for w in words], np.int64)


def coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _word_codes(words), *_grams(words)


def _weights(coded: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What a word's sum over its runs is divided by."""
    return np.sqrt(np.diff(np.r_[coded[2], len(coded[1])]))[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and the passes over windows of word numbers."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {
            "word": 0.1 * init(WORDS, DIM) * np.sqrt(WORDS), "gram": 0.1 * init(GRAMS, DIM) * np.sqrt(GRAMS),
            "wx": init(2, 2 * DIM, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": init(2, HIDDEN, 3 * HIDDEN),
            "wa": init(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": init(ATTENTION, 1)[:, 0],
            "wo": init(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(1, np.float32),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, coded: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """What the network reads of words, given as their codes, their runs' codes and where each word's begin."""
        codes, grams, starts = coded
        chars = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / _weights(coded)
        return np.concatenate([self.p["word"][codes], chars], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, (2, words, 3 hidden); word 0 is the padding."""
        out = np.zeros((2, len(x) + 1, 3 * HIDDEN), x.dtype)
        out[:, 1:] = x @ self.p["wx"] + self.p["b"]
        return out

    def vocabulary_gates(self, words: list[bytes], part: int = 20_000) -> np.ndarray:
        """gates(inputs(words)), a part of the words at a time."""
        out = np.zeros((2, len(words) + 1, 3 * HIDDEN), np.float32)
        for at in range(0, len(words), part):
            out[:, at + 1 : at + part + 1] = self.gates(self.inputs(coded(words[at : at + part])))[:, 1:]
        return out

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows (rows of numbers of gates); with ``keep`` what the backward pass needs."""
        n, t = index.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((t, 2, n, HIDDEN), np.float32)
        steps = []
        k = HIDDEN
        both = np.empty((2, n, 3 * k), np.float32)
        column = np.ascontiguousarray(index.T, np.intp)
        for s in range(t):
            # each direction's gates lie together and "clip" needs no buffer: nothing but the rows taken is copied
            np.take(gates[0], column[s], axis=0, out=both[0], mode="clip")
            np.take(gates[1], column[t - 1 - s], axis=0, out=both[1], mode="clip")
            hu = np.matmul(h, self.p["u"])
            zr = _sigmoid(both[..., : 2 * k] + hu[..., : 2 * k])
            z, r = zr[..., :k], zr[..., k:]
            c = np.tanh(both[..., 2 * k :] + r * hu[..., 2 * k :])
            before, h = h, c + z * (h - c)
            states[s] = h
            if keep:
                steps.append((z, r, c, hu[..., 2 * k :], before))
        full = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)  # (t, n, 2 hidden), both at the same word
        a = np.tanh(full @ self.p["wa"] + self.p["ba"])
        e = np.where(index.T > 0, a @ self.p["va"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[..., None] * full).sum(axis=0)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return (logit, (steps, full, a, weight, pooled)) if keep else logit

    def backward(self, gates: np.ndarray, index: np.ndarray, kept, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of the gates' rows."""
        steps, full, a, weight, pooled = kept
        n, t = index.shape
        k = HIDDEN
        g = {"wo": pooled.T @ d, "bo": d.sum(keepdims=True)}
        dpool = d[:, None] * self.p["wo"]
        dfull = weight[..., None] * dpool[None]
        dweight = (full * dpool[None]).sum(-1)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = (a * de[..., None]).sum((0, 1))
        da = de[..., None] * self.p["va"] * (1 - a * a)
        flat = da.reshape(-1, ATTENTION)
        g["wa"], g["ba"] = full.reshape(-1, 2 * k).T @ flat, flat.sum(0)
        dfull += da @ self.p["wa"].T
        dh = np.zeros((2, n, k), np.float32)
        g["u"] = np.zeros_like(self.p["u"])
        dgates = np.zeros_like(gates)
        for s in range(t - 1, -1, -1):
            z, r, c, hun, before = steps[s]
            dh[0] += dfull[s, :, :k]
            dh[1] += dfull[t - 1 - s, :, k:]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * hun * r * (1 - r)
            dpre = np.concatenate([dz, dr, dc], axis=-1)
            dhu = np.concatenate([dz, dr, dc * r], axis=-1)
            g["u"] += np.matmul(before.transpose(0, 2, 1), dhu)
            np.add.at(dgates[0], index[:, s], dpre[0])
            np.add.at(dgates[1], index[:, t - 1 - s], dpre[1])
            dh = dh * z + np.matmul(dhu, self.p["u"].transpose(0, 2, 1))
        return g, dgates

    def gradients(self, coded: tuple[np.ndarray, np.ndarray, np.ndarray], index: np.ndarray, slope, mask: np.ndarray | float = 1.0) -> dict:
        """Gradients of all parameters; ``slope`` gives the loss's derivative of the logits, ``mask`` multiplies the inputs."""
        codes, grams, starts = coded
        x = self.inputs(coded) * mask
        gates = self.gates(x)
        logit, kept = self.forward(gates, index, keep=True)
        g, dgates = self.backward(gates, index, kept, slope(logit))
        dg = dgates[:, 1:]
        g["wx"], g["b"] = np.matmul(x.T[None], dg), dg.sum(axis=1, keepdims=True)
        dx = np.matmul(dg, self.p["wx"].transpose(0, 2, 1)).sum(axis=0) * mask
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], codes, dx[:, :DIM])
        np.add.at(g["gram"], grams, np.repeat(dx[:, DIM:] / _weights(coded), np.diff(np.r_[starts, len(grams)]), axis=0))
        return g


def windows_of(n: int) -> list[int]:
    """Starts of windows over n words: half a window apart, the last ending with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _windows(numbers: np.ndarray) -> np.ndarray:
    if len(numbers) < WINDOW:
        numbers = np.concatenate([numbers, np.zeros(WINDOW - len(numbers), numbers.dtype)])
    return np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)[windows_of(len(numbers))]


class _Numbers(dict):
    """word -> number from 1 on, and the words that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self) + 1
        return n


class ToxicityModel:
    """A network with its calibration; without a network every score is 0."""

    def __init__(self, net: Network | None = None, slope: float = 1.0, shift: float = 0.0, share: float = 0.0):
        self.net, self.slope, self.shift, self.share = net, slope, shift, share

    def scores(self, batches: Iterator[list[str | None]]) -> Iterator[np.ndarray]:
        """Scores of texts, batch by batch; words are remembered from one batch to the next."""
        numbers, gates = _Numbers(), None
        for texts in batches:
            if self.net is None:
                yield np.zeros(len(texts))
                continue
            if len(numbers) > 200_000:
                numbers, gates = _Numbers(), None
            lists = [_inputs_of(t if isinstance(t, str) else None) for t in texts]
            index, owner, held = [], [], 0
            out = np.full(len(texts), -np.inf)
            places = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in lists]
            if numbers.new:
                fresh = self.net.vocabulary_gates(numbers.new)
                if gates is None:
                    gates = np.zeros((2, 1 << 14, 3 * HIDDEN), np.float32)
                while gates.shape[1] <= len(numbers):
                    gates = np.concatenate([gates, np.zeros_like(gates)], axis=1)
                gates[:, len(numbers) - len(numbers.new) + 1 : len(numbers) + 1] = fresh[:, 1:]
                numbers.new = []
            for i, c in enumerate(places):
                if len(c):
                    w = _windows(c)
                    index.append(w)
                    owner.append(np.full(len(w), i))
                    held += len(w)
                if index and (held >= 2048 or i == len(places) - 1):
                    flat, who = np.concatenate(index), np.concatenate(owner)
                    for at in range(0, len(flat), 2048):
                        np.maximum.at(out, who[at : at + 2048], self.net.forward(gates, flat[at : at + 2048]))
                    index, owner, held = [], [], 0
            if index:
                flat, who = np.concatenate(index), np.concatenate(owner)
                np.maximum.at(out, who, self.net.forward(gates, flat))
            # sums of float32 differ in their last digits with a batch's size: equal texts shall not
            yield np.where(np.isfinite(out), _sigmoid(self.slope * np.round(out, 4) + self.shift), self.share)


def evidence(seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What each feature says of label 1, from how many documents of each label have it (2, features).

    The signed root of the likelihood ratio of its counts against the sample's share,
    less what the luckiest of so many features without meaning would have: what a small
    sample can't tell from chance says nothing.
    """
    total, share = seen.sum(axis=0), float(y.mean())
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = sum(np.where(seen[k] > 0, seen[k] * np.log(seen[k] / (total * p)), 0) for k, p in ((0, 1 - share), (1, share)))
    root = np.sqrt(np.maximum(ratio, 0)) - math.sqrt(math.log(max(2, (total > 0).sum())))
    return (np.sign(seen[1] - total * share) * np.clip(root, 0, MOST_EVIDENCE)).astype(np.float32)


def fit_toxicity(sample: list[tuple[str, int]], share: float | None = None, epochs: int = EPOCHS, seeds: tuple[int, ...] = SEEDS) -> ToxicityModel:
    """Fit on (text, label); ``share`` is label 1's share where the model is used, else the sample's. Of the seeds' networks the best is taken."""
    numbers = _Numbers()
    texts, y = [], []
    for text, label in sample:
        if words := _inputs_of(text):
            texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            y.append(label)
    y = np.array(y, np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    share = float(y.mean()) if share is None else share
    vocabulary = numbers.new
    codes, (grams, starts) = _word_codes(vocabulary), _all_grams(vocabulary)
    lengths = np.diff(np.r_[starts, len(grams)])
    # a part of either label is not trained on: the score is calibrated by what the network doesn't know
    apart = np.zeros(len(y), bool)
    for v in (0, 1):
        if (y == v).sum() >= LEAST_APART:
            apart[np.flatnonzero(y == v)[::APART]] = True
    seen = np.zeros((2, WORDS), np.int64), np.zeros((2, GRAMS), np.int64)
    for c, label in zip(*([x for x, out in zip(z, apart, strict=True) if not out] for z in (texts, y)), strict=True):
        has = np.unique(c) - 1
        seen[0][int(label), np.unique(codes[has])] += 1
        seen[1][int(label), np.unique(np.concatenate([grams[starts[w] : starts[w] + lengths[w]] for w in has]))] += 1
    pull = [evidence(n, y[~apart]) for n in seen]
    odds = np.r_[np.float32(0), pull[0][codes] + np.add.reduceat(pull[1][grams], starts) / np.sqrt(lengths)].astype(np.float32)
    flat = np.concatenate([_windows(c) for c in texts])
    counts = [len(windows_of(len(c))) for c in texts]
    first = np.r_[0, np.cumsum(counts)[:-1]]
    owner = np.repeat(np.arange(len(y)), counts)
    told = np.concatenate([(part := odds[flat[at : at + 8192]]).max(axis=1) + 1e-3 * part.sum(axis=1) for at in range(0, len(flat), 8192)])

    def trained(seed: int) -> tuple[float, ToxicityModel]:
        """(loss on the documents set apart, the model) from one start."""
        value = told
        net, rng = Network(seed), np.random.default_rng(seed)
        net.p["word"][:, 0] += pull[0]
        net.p["gram"][:, 0] += pull[1]
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
        weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
        step = 0

        def best() -> np.ndarray:
            """The window of each document with the highest value."""
            order = np.lexsort((value, owner))
            return order[np.r_[first[1:], len(order)] - 1]

        size = int(np.clip((len(y) + (y == 0).sum()) // 16, 32, BATCH))
        passes = int(np.clip(LEAST_STEPS * size // (len(y) + (y == 0).sum()), epochs, max(epochs, MOST_EPOCHS)))
        for epoch in range(passes):
            chosen = best()[~apart]
            # a second window of each clean document, by chance: not only the worst are clean
            clean = (y == 0) & ~apart
            extra = first[clean] + rng.integers(0, np.array(counts)[clean])
            rows = np.concatenate([chosen, extra])
            rng.shuffle(rows)
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                used, local = np.unique(flat[part], return_inverse=True)
                used = used[used > 0] if used[0] == 0 else used
                local = local.reshape(len(part), WINDOW) + (0 if (flat[part] == 0).any() else 1)
                spans = [np.arange(starts[w - 1], starts[w - 1] + lengths[w - 1]) for w in used]
                some = codes[used - 1], grams[np.concatenate(spans)], np.r_[0, np.cumsum(lengths[used - 1])[:-1]]
                mask = ((rng.random((len(used), 2 * DIM)) >= DROPPED) / (1 - DROPPED)).astype(np.float32)
                grads = net.gradients(some, local, lambda logit: (weight[owner[part]] * (_sigmoid(logit) - y[owner[part]]) / len(part)).astype(np.float32), mask)
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    if k in ("word", "gram"):
                        net.p[k] *= 1 - RATE * DECAY
                    net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            if epoch % 3 == 2 or epoch == passes - 1:
                gates = net.vocabulary_gates(vocabulary)
                value = np.concatenate([net.forward(gates, flat[at : at + 2048]) for at in range(0, len(flat), 2048)])
                del gates  # else it lies beside the next one while that is made

        # Platt's scaling of the highest window, weighted to the share in use
        top, known = value[best()].astype(np.float64), y
        if apart.any() and 0 < y[apart].mean() < 1:
            top, known = top[apart], y[apart]
        w = np.where(known > 0, share / known.mean(), (1 - share) / (1 - known.mean()))
        slope, shift = 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(slope * top + shift)
            r, q = w * (p - known), w * p * (1 - p) + 1e-9
            gradient = np.array([(r * top).sum() + 1e-2 * (slope - 1), r.sum()])
            hessian = np.array([[(q * top * top).sum() + 1e-2, (q * top).sum()], [(q * top).sum(), q.sum() + 1e-6]])
            move = np.linalg.solve(hessian, gradient)
            slope, shift = slope - float(np.clip(move[0], -1, 1)), shift - float(np.clip(move[1], -2, 2))
        p = np.clip(_sigmoid(slope * top + shift), 1e-6, 1 - 1e-6)
        loss = float((w * np.where(known > 0, -np.log(p), -np.log(1 - p))).mean())
        return loss, ToxicityModel(net, max(slope, 1e-3), shift, share)

    # a network's result hangs on its start: of several, that which the documents set apart speak for
    return min((trained(s) for s in seeds), key=lambda x: x[0])[1]


def fit_from_tables(docs: DataFrame, labels: DataFrame, kept_out, most: int = SAMPLE) -> ToxicityModel:
    sample = labelled_sample(docs, labels, "toxic", kept_out, most)
    share = labels.where(~kept_out & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    return fit_toxicity(sample, share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with ``score`` in place of the text."""
    rest = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def texts() -> Iterator[list]:
            for pdf in batches:
                held.append(pdf)
                yield pdf[text_col].tolist()

        for scores in model.scores(texts()):
            pdf = held.pop()
            yield pdf[rest].assign(score=scores.astype(np.float64))

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", score double"
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`")).transform(map_frames, run, schema)


def op4_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from those whose id's checksum is not divisible by 5."""
    short_batches(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_from_tables(docs, labels, held_out(F.col("doc_id")))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

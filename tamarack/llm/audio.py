"""Chroma fingerprints of audio columns, and their alignment.

A recording becomes overlapping frames, each frame twelve pitch-class energies; the
image of classes over time is smoothed and summed up into an integral image, on
which sixteen filters compare the sums of rectangles. Each comparison gives two
bits, so each place in time gives a packed 32-bit code.

Alignment takes the queries in blocks of bounded size, each of which goes to all tasks
as a table: its codes, sorted under each of several masks of 22 bits (at the places
where the masked code changes, so that a held sound is one key). A task looks the codes
of its recordings up, counts the hits at each offset between two recordings, and
confirms every offset hit by the share of differing bits of the codes that overlap
there; each that passes is reported. Of pairs that would pass, no code of which agrees
under any mask, some are lost: for independent bit errors at most one in twenty of the
shortest overlap and the largest share of errors, far fewer of longer or better ones.
Overlaps of fewer than ``OVERLAP`` codes are not looked at. Recordings with equal codes
are one class: classes are compared, and members are named with their class. Places
where the sound is silent have no code to look up, so silence is no common key.

Defined cases: null, empty or unreadable audio has no codes and matches nothing;
recordings shorter than a filter have none either; equal recordings are one class;
ids that are null are fingerprinted but neither queries nor matches; an empty table
gives no rows; ``fingerprint_column`` carries other columns along, except ``codes``
and ``sounding``, which are replaced.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_frames, materialize, read, short_batches

RATE, FRAME, HOP = 11025, 4096, 1365
#: Format tags of WAV, and the kinds of samples that are read.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
FORMATS = {(PCM, 8): "u1", (PCM, 16): "<i2", (PCM, 24): None, (PCM, 32): "<i4", (FLOAT, 32): "<f4", (FLOAT, 64): "<f8"}
LOWEST, HIGHEST = 28.0, 3520.0
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
WIDTH = 16
#: Filters: kind, first class, classes, frames. Kinds compare: lower with upper half, earlier with later half,
#: diagonal quarters, middle third with outer thirds over classes, the same over frames.
FILTERS = [(kind, first, classes, frames) for kind, first, classes, frames in zip([1, 2, 3, 4, 5, 1, 2, 3, 1, 2, 4, 5, 2, 1, 3, 2], [0, 0, 0, 0, 0, 4, 6, 2, 8, 3, 3, 6, 9, 2, 6, 0], [12, 12, 12, 12, 12, 8, 6, 8, 4, 3, 9, 6, 3, 4, 6, 6], [4, 8, 8, 6, 9, 8, 4, 4, 6, 6, 4, 12, 16, 12, 6, 12], strict=True)]
#: Log ratios at which a comparison changes its two bits; Gray code, so that neighbours differ in one.
EDGES, GRAY = np.array([-0.25, 0.0, 0.25], np.float32), np.array([0, 1, 3, 2], np.uint32)
#: Masks of bits under which codes are looked up: each leaves out ten, drawn anew.
LOOKUPS = tuple(sum(1 << int(b) for b in np.random.default_rng(seed).permutation(32)[:22]) for seed in range(24))
#: Hits (under any mask) that make a candidate, share of bits that may differ, codes that must overlap.
HITS, BIT_ERRORS, OVERLAP = 1, 0.15, 8
#: Codes of a block of queries, about; codes of recordings, and hits, that a task holds at once.
QUERY_CODES, HELD_CODES, HELD_HITS = 100_000, 20_000, 250_000
#: Recordings that are made and sent on at once.
MADE = 32
ALIGNED = "query bigint, match bigint, offset bigint, hits bigint, bit_errors double"
#: Energy, as a share of the recording's loudest frame, below which a frame is silent.
SILENCE = 1e-5


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV of samples between -1 and 1."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def read_wav(data) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples) of a WAV of whole numbers of 8, 16, 24 or 32 bits or floats of 32 or 64; None if it isn't one."""
    if not isinstance(data, (bytes, bytearray)) or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == EXTENSIBLE and len(body) >= 26:
                form = struct.unpack("<H", body[24:26]) + form[1:]
        if name == b"data" and form:
            tag, channels, rate, _, _, bits = form
            if (tag, bits) not in FORMATS or not channels or not rate:
                return None
            body = body[: len(body) // (bits // 8 * channels) * (bits // 8 * channels)]
            if bits == 24:  # as the upper bytes of 32 bits
                wide = np.zeros((len(body) // 3, 4), np.uint8)
                wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
                x = wide.view("<i4")[:, 0]
            else:
                x = np.frombuffer(body, FORMATS[tag, bits])
            if tag == FLOAT:
                x = np.nan_to_num(x.astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)
            else:
                x = (x.astype(np.float32) - 128) / 128 if bits == 8 else x.astype(np.float32) / float(1 << (15 if bits == 16 else 31))
            return rate, x.reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    return None


def _classes() -> np.ndarray:
    """Matrix from the spectrum's bins to pitch classes."""
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(f), 12), np.float32)
    used = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[used, np.round(12 * np.log2(f[used] / 440.0)).astype(int) % 12] = 1
    return out


_TO_CLASSES = _classes()
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Smoothed pitch-class frames of unit length; silent frames are zero."""
    if rate != RATE and len(samples):
        n = int(len(samples) * RATE / rate)
        samples = np.interp(np.arange(n) * rate / RATE, np.arange(len(samples)), samples).astype(np.float32)
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), 12), np.float32)
    for at in range(0, len(frames), 256):  # long recordings in parts
        s = np.fft.rfft(frames[at : at + 256] * _HANN, axis=1)
        out[at : at + 256] = (s.real**2 + s.imag**2) @ _TO_CLASSES
    if len(out) < len(SMOOTHING):
        return np.zeros((0, 12), np.float32)
    smooth = sum(c * out[k : len(out) - len(SMOOTHING) + 1 + k] for k, c in enumerate(SMOOTHING))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > SILENCE * norm.max(initial=0), smooth / np.maximum(norm, 1e-30), 0).astype(np.float32)


def codes_of(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, whether there is sound) for each place of a WIDTH-frame window."""
    places = len(image) - WIDTH + 1
    if places <= 0:
        return np.empty(0, np.uint32), np.empty(0, bool)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)
    at = np.arange(places)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(places, np.uint32)
    for kind, c, n, w in FILTERS:
        whole = area(0, w, c, c + n)
        if kind == 1:
            a = area(0, w, c, c + n // 2)
        elif kind == 2:
            a = area(0, w // 2, c, c + n)
        elif kind == 3:
            a = area(0, w // 2, c, c + n // 2) + area(w // 2, w, c + n // 2, c + n)
        elif kind == 4:
            a = area(0, w, c + n // 3, c + n - n // 3)
        else:
            a = area(w // 3, w - w // 3, c, c + n)
        share = {4: 2.0, 5: 2.0}.get(kind, 1.0)  # thirds: the middle weighs as much as what is around it
        out = out << np.uint32(2) | GRAY[np.searchsorted(EDGES, np.log1p(share * a) - np.log1p(np.maximum(whole - a, 0)))]
    sound = np.abs(image).sum(axis=1) > 0
    heard = np.concatenate([[0], np.cumsum(sound)])
    return out, heard[at + WIDTH] - heard[at] >= WIDTH // 2


def fingerprint_column(df: DataFrame, audio_col: str, keep_audio: bool = False) -> DataFrame:
    """df with ``codes`` array<int> and ``sounding`` array<boolean> for a column of WAV files."""
    short_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in ("codes", "sounding") and (keep_audio or c != audio_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for data in pdf[audio_col]:
                sound = read_wav(data)
                found.append(codes_of(chroma(sound[1], sound[0])) if sound else (np.empty(0, np.uint32), np.empty(0, bool)))
            yield pdf[rest].assign(codes=[c.view(np.int32) for c, _ in found], sounding=[s for _, s in found])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + ", codes array<int>, sounding array<boolean>"
    return df.transform(map_frames, run, schema)


class Codes:
    """The codes of several recordings one after another, and where they can be looked up."""

    def __init__(self, codes: list[np.ndarray], sounding: list[np.ndarray]):
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)][:-1]
        self.flat = np.concatenate([*codes, np.empty(0, np.int32)]).astype(np.int32).view(np.uint32)
        self.owner = np.repeat(np.arange(len(codes)), self.lengths)
        self.sounding = np.concatenate([*sounding, np.empty(0, bool)]).astype(bool)

    def keys(self, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """(masked codes, their places) of the places with sound at which the masked code isn't that before."""
        key = self.flat & np.uint32(mask)
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & self.sounding[:-1] & (self.owner[1:] == self.owner[:-1])
        at = np.flatnonzero(self.sounding & ~again)
        return key[at], at


class QueryTable:
    """A block of queries: for each mask the sorted keys and their places."""

    def __init__(self, ids: list[int], codes: list[np.ndarray], sounding: list[np.ndarray]):
        self.ids, self.codes, self.sorted = np.array(ids, np.int64), Codes(codes, sounding), []
        for mask in LOOKUPS:
            key, at = self.codes.keys(mask)
            order = np.argsort(key, kind="stable")
            self.sorted.append((key[order], at[order].astype(np.int32)))

    def offsets(self, mine: Codes) -> tuple[np.ndarray, ...]:
        """(recording, query, offset, hits): the histogram of offsets at which codes agree."""
        cells, hits = np.empty(0, np.int64), np.empty(0, np.int64)
        for mask, (known, places) in zip(LOOKUPS, self.sorted, strict=True):
            key, at = mine.keys(mask)
            low, high = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
            met = np.flatnonzero(high > low)
            total = np.cumsum(high[met] - low[met])
            for part in np.split(met, np.flatnonzero(np.diff(total // HELD_HITS)) + 1):
                count = high[part] - low[part]
                if not count.size:
                    continue
                own = np.repeat(at[part], count)
                other = places[np.repeat(low[part] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
                recording, query = mine.owner[own], self.codes.owner[other]
                offset = (own - mine.starts[recording]) - (other - self.codes.starts[query])
                cell = (recording << 50) | (query << 30) | (offset + (1 << 29))
                cells, back = np.unique(np.concatenate([cells, cell]), return_inverse=True)
                hits = np.bincount(back, np.concatenate([hits, np.ones(len(cell), np.int64)])).astype(np.int64)
        return cells >> 50, (cells >> 30) & ((1 << 20) - 1), (cells & ((1 << 30) - 1)) - (1 << 29), hits

    def aligned(self, mine: Codes) -> tuple[np.ndarray, ...]:
        """(recording, query, offset, hits, share of differing bits) of the confirmed offsets."""
        recording, query, offset, hits = self.offsets(mine)
        start = np.maximum(0, -offset)
        n = np.minimum(self.codes.lengths[query] - start, mine.lengths[recording] - start - offset)
        kept = np.flatnonzero((hits >= HITS) & (n >= OVERLAP))
        kept = kept[np.argsort(-n[kept], kind="stable")]  # those with most codes first: the others drop out on the way
        recording, query, offset, hits, start, n = (x[kept] for x in (recording, query, offset, hits, start, n))
        a, b, errors = self.codes.starts[query] + start, mine.starts[recording] + start + offset, np.zeros(len(n), np.int64)
        for t in range(int(n.max(initial=0))):
            still = np.searchsorted(-n, -t, side="left")
            errors[:still] += np.bitwise_count(self.codes.flat[a[:still] + t] ^ mine.flat[b[:still] + t])
        share = np.round(errors / (32 * n), 6)
        return tuple(x[share <= BIT_ERRORS] for x in (recording, query, offset, hits, share))


def align(recordings: DataFrame, queries: DataFrame, id_col: str = "id") -> DataFrame:
    """query, match, offset, hits, bit_errors: confirmed alignments of rows (id, codes, sounding), the query's start taken from the match's."""
    spark = recordings.sparkSession
    plain = lambda df: df.where(F.col(id_col).isNotNull() & (F.size("codes") > 0)).select(F.col(id_col).cast("bigint").alias("id"), "codes", "sounding")
    asked = plain(queries)
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("codes"))).first()[0] or 0) / QUERY_CODES))
    found = spark.createDataFrame([], ALIGNED)
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        arrays = lambda name, part=part: [np.array(x) for x in part[name].to_pylist()]
        shared = spark.sparkContext.broadcast(QueryTable(part["id"].to_pylist(), arrays("codes"), arrays("sounding")))  # a block of the stated queries

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            table = shared.value
            for pdf in batches:
                for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(pdf.codes.map(len)) // HELD_CODES)) + 1) if len(pdf) else ():
                    rows = pdf.iloc[at]
                    recording, query, offset, hits, share = table.aligned(Codes(list(rows.codes), list(rows.sounding)))
                    yield pd.DataFrame({"query": table.ids[query], "match": rows["id"].to_numpy(np.int64)[recording], "offset": offset, "hits": hits, "bit_errors": share})

        found = found.unionByName(plain(recordings).transform(map_frames, run, ALIGNED))
    return found


def melody(values: np.ndarray, lead: int) -> np.ndarray:
    """A test sound: ``lead`` hops of silence, then a tone for each value, a hop each, with its octave."""
    t = np.arange(HOP, dtype=np.float32) / RATE
    pitch = 220.0 * 2.0 ** ((np.floor((np.nan_to_num(values.astype(np.float64)) + 1) * 97) % 24) / 12)
    phase = 2 * math.pi * pitch[:, None] * t[None]
    sound = (0.5 * np.sin(phase) + 0.2 * np.sin(2 * phase)).astype(np.float32).ravel()
    return np.concatenate([np.zeros(lead * HOP, np.float32), sound, np.zeros(FRAME, np.float32)])


def sonified(vectors: DataFrame) -> DataFrame:
    """id, audio: a recording of each row of ``embeddings``, since the tables have no sound of their own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), MADE):
                pdf = batch.iloc[at : at + MADE]
                sounds = [None if v is None else wav_bytes(melody(np.asarray(v), 0 if pd.isna(i) else int(i) % 5)) for i, v in zip(pdf.vec_id, pdf.embedding, strict=True)]
                yield pd.DataFrame({"id": pdf.vec_id, "audio": sounds})

    return vectors.select("vec_id", "embedding").transform(map_frames, run, "id bigint, audio binary")


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording with its codes' hash and its class of equal ones; the class's smallest id has a row for each alignment with a query.

    Queries are the recordings whose id is divisible by 50, by their classes.
    """
    short_batches(spark)
    found = materialize(fingerprint_column(sonified(read(spark, sf_dir, "embeddings")), "audio").withColumn("code_hash", F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256)), "codes")
    coded = found.where("id is not null and size(codes) > 0")
    classes = materialize(coded.groupBy("code_hash").agg(F.min("id").alias("id"), F.any_value("codes").alias("codes"), F.any_value("sounding").alias("sounding"), F.bool_or(F.col("id") % 50 == 0).alias("asked")), "classes")
    matched = align(classes, classes.where("asked")).select(F.col("match").alias("id"), F.col("query").alias("query_class"), "offset", "bit_errors")
    named = found.join(classes.select("code_hash", F.col("id").alias("class_id")), "code_hash", "left").join(matched, "id", "left")
    return named.select(F.col("id").alias("vec_id"), F.size("codes").cast("bigint").alias("n_codes"), "code_hash", F.when(F.size("codes") > 0, F.col("class_id")).alias("class_id"), "query_class", "offset", "bit_errors")

import struct

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm import audio as A

from .conftest import HUGE


def sound(seed, lead=0, n=60, noise=0.0):
    rng = np.random.default_rng(seed)
    x = A.melody(rng.standard_normal(n), lead)
    return x + noise * np.random.default_rng(seed + 99).standard_normal(len(x)).astype(np.float32)


def test_wav_round_trip():
    x = sound(1)
    rate, y = A.read_wav(A.wav_bytes(x))
    assert rate == A.RATE and np.abs(x - y).max() < 1e-3
    assert A.read_wav(b"") is None and A.read_wav(b"RIFFxxxxWAVE") is None and A.read_wav(None) is None


def test_kinds_of_samples():
    x = np.array([0.5, -0.25, 0.125, -1.0], np.float32)

    def wav(tag, bits, data, extra=b""):
        form = struct.pack("<HHIIHH", tag, 1, 11025, 11025 * bits // 8, bits // 8, bits) + extra
        return b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data

    three = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x)
    whole = (x * 32768).astype("<i2").tobytes()
    for data in (wav(3, 32, x.astype("<f4").tobytes()), wav(3, 64, x.astype("<f8").tobytes()), wav(1, 24, three), wav(1, 16, whole), wav(1, 32, (x.astype(float) * (1 << 31)).astype("<i4").tobytes()), wav(0xFFFE, 16, whole, struct.pack("<HHIH", 22, 16, 4, 1) + bytes(14))):
        assert np.allclose(A.read_wav(data)[1], x, atol=1e-4)
    assert A.read_wav(wav(1, 12, whole)) is None and A.read_wav(wav(85, 16, whole)) is None


def test_quiet_recordings_have_the_codes_of_loud_ones():
    x = sound(8)
    loud, quiet = A.codes_of(A.chroma(x, A.RATE)), A.codes_of(A.chroma(x * np.float32(1e-3), A.RATE))
    assert quiet[1].any() and (loud[1] == quiet[1]).all() and np.bitwise_count(loud[0] ^ quiet[0]).mean() < 0.5


def test_long_recordings_have_the_codes_of_their_parts():
    x = np.concatenate([sound(s, n=200) for s in range(6)])
    codes, _ = A.codes_of(A.chroma(x, A.RATE))
    part, _ = A.codes_of(A.chroma(x[700 * A.HOP :], A.RATE))
    assert (codes[700:] == part).mean() > 0.95


def test_a_held_sound_is_one_key(spark):
    rows = [(i, [7] * 500, [True] * 500) for i in (1, 2)]
    df = spark.createDataFrame(rows, "id bigint, codes array<int>, sounding array<boolean>")
    got = A.align(df, df.where("id = 1")).collect()
    assert {(r["match"], r["offset"], r["hits"]) for r in got} == {(1, 0, len(A.LOOKUPS)), (2, 0, len(A.LOOKUPS))}


def test_integral_filters_are_rectangle_sums():
    image = np.random.default_rng(2).random((40, 12)).astype(np.float32)
    codes, sounding = A.codes_of(image)
    assert len(codes) == 25 and sounding.all()
    for place in (0, 7, 24):
        code = 0
        for kind, c, n, w in A.FILTERS:
            box = image[place : place + w, c : c + n].astype(np.float64)
            a = {1: lambda: box[:, : n // 2], 2: lambda: box[: w // 2], 4: lambda: box[:, n // 3 : n - n // 3], 5: lambda: box[w // 3 : w - w // 3]}.get(kind)
            s = a().sum() if a else box[: w // 2, : n // 2].sum() + box[w // 2 :, n // 2 :].sum()
            v = np.log1p((2 if kind in (4, 5) else 1) * s) - np.log1p(box.sum() - s)
            code = code << 2 | int(A.GRAY[np.searchsorted(A.EDGES, v)])
        assert codes[place] == code


def recordings(spark, rows):
    return A.fingerprint_column(spark.createDataFrame([(i, bytearray(b) if b is not None else None, "x") for i, b in rows], "id bigint, audio binary, codes string"), "audio")


def test_shifted_and_noisy_recordings_align(spark):
    rows = [(i, A.wav_bytes(sound(i))) for i in range(12)]
    rows += [(100, A.wav_bytes(sound(3, lead=4))), (101, A.wav_bytes(sound(5, noise=0.003))), (102, A.wav_bytes(np.zeros(90000))), (103, None), (104, b"junk"), (105, A.wav_bytes(np.zeros(10))), (HUGE, A.wav_bytes(sound(3))), (None, A.wav_bytes(sound(4)))]
    found = recordings(spark, rows).cache()
    sizes = {r["id"]: len(r["codes"]) for r in found.collect()}
    assert sizes[103] == sizes[104] == sizes[105] == 0 and sizes[3] > 30 and HUGE in sizes and None in sizes
    usable = found.where("id is not null")
    got = {(r["query"], r["match"]): r["offset"] for r in A.align(usable, usable.where("id in (3, 5, 102)")).collect()}
    assert got == {(3, 3): 0, (3, 100): 4, (3, HUGE): 0, (5, 5): 0, (5, 101): 0}


def test_other_rates_sound_alike():
    x = sound(7)
    t = np.arange(0, len(x) - 1, 0.5)
    a, _ = A.codes_of(A.chroma(x, A.RATE))
    b, _ = A.codes_of(A.chroma(np.interp(t, np.arange(len(x)), x).astype(np.float32), 2 * A.RATE))
    n = min(len(a), len(b))
    bits = np.mean([bin(int(p ^ q)).count("1") for p, q in zip(a[:n], b[:n], strict=True)]) / 32
    assert bits < 0.1


def test_query_names_classes(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = [rng.standard_normal(64).astype(float).tolist() for _ in range(30)]
    rows = [(i, vectors[i % 30], 1) for i in range(60)] + [(70, None, 1), (None, vectors[0], 1), (100, vectors[5], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = A.op2_chroma_fingerprints(spark, str(tmp_path)).collect()
    out = {r["vec_id"]: r for r in rows}
    assert len(out) == 63 and out[70]["class_id"] is None and out[35]["class_id"] == 5
    pairs = {(r["vec_id"], r["query_class"]): (r["offset"], r["bit_errors"]) for r in rows if r["query_class"] is not None}
    assert pairs[0, 0] == pairs[20, 20] == (0, 0.0)
    # 50 is in the class of 20 and 100 in that of 5: classes are what is asked for and found
    assert {q for _, q in pairs} <= {0, 5, 20} and all(out[v]["class_id"] == v for v, _ in pairs)
    assert A.align(recordings(spark, []), recordings(spark, [])).where(F.lit(True)).count() == 0


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for q in range(20):
        clean = rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32)
        rows.append((q, clean))
        for k, p in enumerate((0.05, 0.1, 0.12, 0.14)):
            flips = (rng.random((60, 32)) < p) @ (1 << np.arange(32, dtype=np.uint64))
            rows.append((100 * (k + 1) + q, clean ^ flips.astype(np.uint32)))
    rows.append((900, np.concatenate([rows[0][1], rng.integers(0, 1 << 32, 30, dtype=np.uint64).astype(np.uint32), rows[0][1]])))
    for q, a in [r for r in rows if r[0] < 20]:
        for m, b in rows:
            for off in range(-len(a) + A.OVERLAP, len(b) - A.OVERLAP + 1):
                start = max(0, -off)
                n = min(len(a) - start, len(b) - start - off)
                if n >= A.OVERLAP and round(np.bitwise_count(a[start : start + n] ^ b[start + off : start + off + n]).sum() / (32 * n), 6) <= A.BIT_ERRORS:
                    want.add((q, m, off))
    df = spark.createDataFrame([(i, c.view(np.int32).tolist(), [True] * len(c)) for i, c in rows], "id bigint, codes array<int>, sounding array<boolean>")
    got = {(r["query"], r["match"], r["offset"]) for r in A.align(df, df.where("id < 20")).collect()}
    assert {(0, 900, 0), (0, 900, 90)} <= want & got
    assert got <= want and len(got) >= 0.9 * len(want)


def test_recall_of_each_overlap_and_share_of_errors(spark):
    rng = np.random.default_rng(21)
    rows, cells = [], {}
    for c, (n, p) in enumerate((n, p) for n in (A.OVERLAP, 16, 30, 60) for p in (0.05, 0.1, 0.12, 0.14)):
        for k in range(60):
            q, m = 10_000 + 1000 * c + k, 50_000 + 1000 * c + k
            a, b = (rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32) for _ in range(2))
            flips = ((rng.random((n, 32)) < p) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32)
            b[:n] = a[60 - n :] ^ flips  # the query's end is the match's beginning
            rows += [(q, a), (m, b)]
            if round(np.bitwise_count(flips).sum() / (32 * n), 6) <= A.BIT_ERRORS:
                cells.setdefault((n, p), set()).add((q, m, n - 60))
    df = spark.createDataFrame([(i, c.view(np.int32).tolist(), [True] * len(c)) for i, c in rows], "id bigint, codes array<int>, sounding array<boolean>").cache()
    got = {(r["query"], r["match"], r["offset"]) for r in A.align(df.where("id >= 50000"), df.where("id < 50000")).collect()}
    found = {cell: len(want & got) / len(want) for cell, want in cells.items()}
    assert len(found) == 16 and min(found.values()) >= 0.9, found


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(22)
    rows = [(i, rng.integers(-(1 << 31), 1 << 31, 20).tolist(), [True] * 20) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, *rows[0][1:]), (99, [], []), (98, rows[3][1], [False] * 20)], "id bigint, codes array<int>, sounding array<boolean>")
    once = sorted(map(tuple, A.align(df, df).collect()))
    monkeypatch.setattr(A, "QUERY_CODES", 150)
    monkeypatch.setattr(A, "HELD_CODES", 30)
    assert sorted(map(tuple, A.align(df, df).collect())) == once and {(i, i, 0) for i in range(40)} <= {r[:3] for r in once} and not {98, 99} & {x for r in once for x in r[:2]}

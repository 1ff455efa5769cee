import hashlib
import math

import numpy as np
import pytest

from tamarack.llm import codes as C

from .conftest import HUGE

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, vector int, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


def brute(rows, parts, entries, rounds):
    """By Python's integers, one vector after another."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    width = len(seeds[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(s[1])[p] for s in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v)[p], book)[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(book)]
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(x, book) for x, book in zip(cut(v), books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=str), digest


def run(spark, rows, **kw):
    out, books = C.vector_codes(table(spark, rows), **kw)
    return sorted(map(tuple, out.select("vec_id", "code", "error", "label_error").collect()), key=str), C.books_sha256(books)


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_are_those_of_plain_integers(spark, seed):
    rng = np.random.default_rng(seed)
    hot = rng.standard_normal(12).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(12).astype(np.float32).tolist(), [None, 1, 2, 3][i % 4]) for i in range(150)]
    rows += [(200, None, 1), (201, [None, *hot[1:]], 1), (202, [float("nan"), *hot[1:]], 1), (203, [float("inf"), *hot[1:]], 2), (HUGE, hot, 2), (None, hot, 9), (5, hot, 1), (7, rng.standard_normal(12).tolist(), None), (-4, hot, None)]
    rng.shuffle(rows)
    assert run(spark, rows, entries=20, rounds=3) == brute(rows, 4, 20, 3)


def test_blocks_and_labels_of_any_number(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    monkeypatch.setattr(C, "AT_ONCE", 5)
    monkeypatch.setattr(C, "HOT_SHARE", 0.2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist(), 0 if i % 2 else i) for i in range(90)]
    assert run(spark, rows, entries=256, rounds=2) == brute(rows, 4, 256, 2)  # fewer vectors than entries, many ties


def test_components_beyond_64_bits(spark):
    rows = [(1, [1e30, -1e30, 0.5, 3e38], 1), (2, [2.0, 1e12, -0.25, 1e20], 1), (3, [1e15, 1.0, 1.0, 1.0], 2), (4, [1e30, -1e30, 0.5, 3e38], 2)]
    got, digest = run(spark, rows, entries=2, rounds=2)
    want, same = brute(rows, 4, 2, 2)
    assert digest == same and [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == [w[2] if w[2] < 1 << 63 else None for w in want]


def test_vectors_that_do_not_fit(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0], 1), (3, [], 1), (4, [4.0, 3.0, 2.0, 1.0], 1)]
    got = {r[0]: r[1] for r in run(spark, rows)[0]}
    assert got == {1: "00000000", 2: None, 3: None, 4: "01010101"}
    assert {r[1] for r in run(spark, [(1, [1.0, 2.0, 3.0], 1)])[0]} == {None}
    assert run(spark, [(None, [1.0] * 4, 1)])[0] == [(None, None, None, None)]
    assert run(spark, []) == ([], hashlib.sha256(b"").hexdigest())


def test_narrow_integers_where_they_do(spark):
    assert C.number_kind(2000, 16, 10**6) is np.int32 and C.number_kind(1 << 20, 64, 10**6) is np.int64 and C.number_kind(1 << 40, 64, 10) is object

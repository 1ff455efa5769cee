import functools
import struct
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tamarack.llm.packing import best_fit_plan, pack, token_pieces, tokenizer

from .conftest import HUGE


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan_is_a_best_fit_of_single_pieces(counts):
    plan = best_fit_plan(counts, 32)
    places, ranks = {}, {}
    for p in plan:
        for r in range(p["lo"], p["hi"]):
            ranks.setdefault(p["length"], []).append(r)
            places.setdefault(p["base"] + (r - p["lo"]) // p["each"], []).append((p["at"] + (r - p["lo"]) % p["each"] * p["length"], p["length"]))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    rooms = []  # best fit, piece by piece, longest first
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - length)
            else:
                rooms.append(32 - length)
    assert len(places) == len(rooms)


def test_ids_are_those_of_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public.path("byte_bpe_50k.json")), tokenizer("byte_bpe_50k")
    for text in ("", "a", "Über 12,5 % – naïve\n\n\n  x", "<|endoftext|> b<|endoftext|>", "日本語 🙂" * 40, " " * 3000, "é" * 5000, "it's we'LL \t\r\n x", "﻿​"):
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA1 \n\t.'é日\u200b\u00a0")), max_size=200))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_tokenizers_for_any_text(text):
    public = pytest.importorskip("public_tokenizers")
    assert tokenizer("byte_bpe_50k")(text) == slow_tokenizer(public.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@functools.cache
def slow_tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_pieces_and_places(spark, docs):
    long = " ".join(f"w{i}" for i in range(4000))
    df = docs([(1, None), (2, ""), (HUGE, "hello world"), (None, "hello world"), (3, long), (3, long), (4, "x")])
    out = pack(token_pieces(df).cache()).toPandas()
    encode = tokenizer("byte_bpe_50k")
    ids = [*encode(long), 2]
    for _, g in out[out.doc_id == 3].groupby("sequence_id"):
        assert len(g) >= 1
    mine = out[out.doc_id == 3].drop_duplicates("piece").sort_values("piece")
    assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 1024).all()
    for r in mine.itertuples():
        part = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert out[out.doc_id.isin([1, 2])].length.tolist() == [1, 1]
    assert HUGE in {r[0] for r in token_pieces(df).select("doc_id").collect()} and out.doc_id.isna().sum() == 1
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024


def test_empty_table(docs):
    assert pack(token_pieces(docs([])).cache()).count() == 0


def test_a_hot_length_is_ranked_in_parts(spark):
    rows = [(i, 0, 3 if i < 2000 else 1 + i % 50, i) for i in range(2500)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, ids_crc32 bigint")
    out = pack(pieces, 64).collect()
    assert len(out) == 2500 and sorted(r["doc_id"] for r in out) == list(range(2500))
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    counts = {}
    for r in rows:
        counts[r[2]] = counts.get(r[2], 0) + 1
    assert len(by) == 1 + max(p["base"] + -(-(p["hi"] - p["lo"]) // p["each"]) - 1 for p in best_fit_plan(counts, 64))

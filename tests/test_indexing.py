"""Lazy indexing by streams and listings, and parsing by splits."""

import os

import pytest
from pyspark.sql import functions as F

from tamarack.plans.engine import Engine
from tamarack.sources import streamed as S
from tamarack.streaming.indexing import LazyIndex


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def found(engine, word):
    return sorted(r["relative_path"] for r in engine.search(word, refresh=False).collect())


def test_new_files_once_and_changes_by_listing(spark, tmp_path):
    root, log = f"{tmp_path}/in", f"{tmp_path}/asked"
    os.makedirs(log)

    def parser(data):
        with open(f"{log}/{os.getpid()}", "ab") as f:
            f.write(data + b"\n")
        return data.decode()

    asked = lambda: sorted({line for n in os.listdir(log) for line in open(f"{log}/{n}").read().split("\n") if line})
    write(root, "a.pdf", "alpha word")
    write(root, "sub/b.md", "beta word")
    engine = Engine(spark, f"{tmp_path}/store", root, parsers={".pdf": parser})
    lazy = LazyIndex(engine, f"{tmp_path}/cp", files_of_batch=1)
    assert [r.indexed for r in lazy.catch_up()] == [1, 1] and found(engine, "word") == ["a.pdf", "sub/b.md"]
    assert lazy.catch_up() == [] and asked() == ["alpha word"]
    write(root, "c.pdf", "gamma word")
    assert [r.indexed for r in lazy.catch_up()] == [1] and asked() == ["alpha word", "gamma word"]
    # a file source doesn't report a file twice: changes and deletions come by the listing
    os.unlink(f"{root}/sub/b.md")
    write(root, "a.pdf", "another text")
    assert lazy.catch_up() == []
    done = lazy.reconcile()
    assert (done.indexed, done.deleted) == (1, 1) and found(engine, "word") == ["c.pdf"] and found(engine, "another") == ["a.pdf"]
    assert asked() == ["alpha word", "another text", "gamma word"]
    again = lazy.reconcile()
    assert (again.indexed, again.deleted) == (0, 0)


def test_a_batch_that_is_given_again_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/in"
    write(root, "a.md", "alpha")
    engine = Engine(spark, f"{tmp_path}/store", root)
    lazy, commit = LazyIndex(engine, f"{tmp_path}/cp"), engine.store.commit

    def lost(*args, **tables):
        commit(*args, **tables)
        raise OSError("the driver is lost behind its commit")

    engine.store.commit = lost
    with pytest.raises(Exception, match="lost"):
        lazy.catch_up()
    engine.store.commit = commit
    number = engine.store.current()[0]
    assert [r.indexed for r in LazyIndex(engine, f"{tmp_path}/cp").catch_up()] == [0] and engine.store.current()[0] == number
    assert found(engine, "alpha") == ["a.md"] and engine.documents.count() == 1


def test_searches_list_only_when_it_is_due(spark, tmp_path):
    root, now = f"{tmp_path}/in", [0.0]
    write(root, "a.md", "alpha word")
    engine = Engine(spark, f"{tmp_path}/store", root)
    lazy = LazyIndex(engine, f"{tmp_path}/cp", new_every=10, reconcile_every=100, clock=lambda: now[0])
    paths = lambda: sorted(r["relative_path"] for r in lazy.search("word").collect())
    assert paths() == ["a.md"]
    write(root, "b.md", "beta word")
    os.unlink(f"{root}/a.md")
    now[0] = 9
    assert paths() == ["a.md"]
    now[0] = 11
    assert paths() == ["a.md", "b.md"]
    now[0] = 120
    assert paths() == ["b.md"]


def test_files_are_read_in_splits(spark, tmp_path):
    root = f"{tmp_path}/in"
    text = [f"line {i} é" * (i % 7) for i in range(3000)]
    write(root, "big.log", "\n".join(text) + "\n")
    write(root, "sub/one.BIN", "abc")
    write(root, "bad.bin", "x")
    write(root, "none.txt", "skipped")
    write(root, "empty.log", "")

    def whole(stream, start, end):
        assert end is None and hasattr(stream, "read")
        first = stream.read(2)
        yield f"{first!r}"
        if len(first) < 2:
            raise ValueError("too short")
        yield f"{stream.read()!r}"

    df = S.parsed_files(spark, root, {".log": S.Parser(S.lines, True), ".bin": S.Parser(whole)}, split=4096)
    assert df.rdd.getNumPartitions() > 5
    rows = df.orderBy("relative_path", "start", "part").collect()
    assert [r["content"] for r in rows if r["relative_path"] == "big.log"] == text
    assert [(r["content"], r["error"]) for r in rows if r["relative_path"] == "sub/one.BIN"] == [("b'ab'", None), ("b'c'", None)]
    assert [(r["content"], r["error"]) for r in rows if r["relative_path"] == "bad.bin"] == [("b'x'", None), (None, "parse_error: too short")]
    assert not [r for r in rows if r["relative_path"] in ("none.txt", "empty.log")]
    assert df.where(F.col("error").isNotNull()).count() == 1


def test_splits_are_of_about_one_size():
    files = [(f"f{i:03d}", 10 << 20) for i in range(30)] + [("large", 1 << 30), ("whole", 1 << 30)]
    made = S.dealt(files, lambda p: p == "large")
    assert [f for s in made for f in s.files if f[0] == "whole"] == [("whole", 0, None)]
    assert sum(len({f[0] for f in s.files} & {"large"}) for s in made) >= 8 and [r[1:] for s in made for r in s.files if r[0] == "large"] == [(a, a + S.SPLIT) for a in range(0, 1 << 30, S.SPLIT)]
    assert max(sum(10 << 20 for f in s.files if f[0].startswith("f")) for s in made) <= S.SPLIT
    assert S.dealt([], lambda p: True) == []

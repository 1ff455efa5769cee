"""The pipeline on planted cases: each stage does to its input what a plain version does."""

import random

import corpus_pipeline as P
from tamarack.llm import common
from tamarack.llm.packing import tokenizer

from .test_neardup import brute

BAD = ("vile", "rotten", "nasty")


def text(r, n):
    return " ".join(f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('rstlmn')}{r.randrange(300)}" for _ in range(n))


def test_stages_on_planted_cases(spark, tmp_path):
    r = random.Random(1)
    items = [text(r, 30) + "." for _ in range(4)]
    docs, toxic = [], set()
    for i in range(160):
        words = text(r, r.randrange(30, 90)).split()
        if i % 4 == 1:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(BAD)
            toxic.add(i)
        docs.append((i, " ".join(words)))
    clean = [(i, t) for i, t in docs if i not in toxic]
    extra = [(200, clean[3][1]), (201, clean[4][1] + " more"), (202, text(r, 20) + " " + items[0] + " " + text(r, 20)), (203, "write to a.b@c.de or 10.0.0.1 now " + text(r, 30)), (204, None), (None, text(r, 40)), (205, "")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs + extra]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({x["doc_id"]: x for x in kept.collect()} if name != "packing" else kept.collect())
        if name != "packing":
            assert kept.columns == P.COLUMNS
    first, second, third, fourth, pieces = seen
    assert not toxic & set(first) and set(first) == {i for i, _ in docs + extra} - toxic
    groups = brute([(i, x["text"]) for i, x in first.items() if i is not None], 5, 80, 100)
    assert set(second) == {i for i in groups if groups[i] == i} | {None} and not {200, 201} & set(second)
    assert set(third) == set(second) - {202}
    assert fourth[203]["text"].startswith("write to [EMAIL] or [IP] now") and fourth[203]["n_chars"] == len(fourth[203]["text"])
    assert all(fourth[i]["text"] == third[i]["text"] for i in third if i != 203)
    encode = tokenizer("byte_bpe_50k")
    total = {i: len(encode(x["text"] or "")) + 1 for i, x in fourth.items()}
    assert {p["doc_id"]: p["length"] for p in pieces} == total
    by: dict = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_and_repeated_rows_and_further_columns(spark, tmp_path):
    r = random.Random(2)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(r, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], schema)
    a, b = text(r, 50), text(r, 50)
    rows = spark.createDataFrame([(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "de", "t", 1), (3, b, None, None, None), (3, text(r, 40), "x", "y", 2), (None, None, None, None, None), (None, a, "en", "s", 1)], schema)
    wide = rows.selectExpr("*", "1 as score", "'k' as kept", "2 as length", "3 as row", "array(1) as spans")
    for df, ids in ((none, []), (rows, [1, 3, None, None]), (wide, [1, 3, None, None])):
        for name, stage in P.STAGES:
            df = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert df.columns == P.COLUMNS
            if name == "near_duplicates":
                assert sorted((x["doc_id"] for x in df.collect()), key=str) == ids
        got = [x["doc_id"] for x in df.collect()]
        assert sorted(got, key=str) == ids


def test_run_is_its_stages_one_after_another(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, text(r, 40), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(10)] + [(200, "mail a.b@c.de " + text(r, 30), "en", "s", 1), (201, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    out = P.run(spark, str(tmp_path))
    # sequences have any numbers, so they aren't compared
    columns = [c for c in kept.columns if c not in ("sequence_id", "offset")]
    assert out.columns == kept.columns and sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, kept.select(columns).collect()))
    ids = {x["doc_id"] for x in out.collect()}
    assert 200 in ids and 7 not in ids and not ids & set(range(100, 110))


def test_texts_move_once_and_tables_on_the_way_are_removed(spark, tmp_path):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, text(r, 40), "en", "s", 1) for i in range(30)] + [(40, "a b c d e f", "en", "s", 1), (41, "a b c d e f", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(r, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[1:3]:
        before = set(common._made)
        out = stage(spark, docs, str(tmp_path))
        assert len(common._made - before) == 1, name  # what the stage reads
        if name == "near_duplicates":
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan
            assert sorted(x["doc_id"] for x in out.collect()) == [*range(30), 40]

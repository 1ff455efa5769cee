import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tamarack.llm.common import WordHashes
from tamarack.llm.substrings import OP10_SQL, WINDOW, FingerprintIndex, _firsts, _had, _send, _unpack, _unplanes, op10_fingerprint_index_repeats, remove_repeats, windows_of

from .conftest import HUGE


def brute(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - WINDOW + 1):
                g = tuple(w[k : k + WINDOW])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if i is not None and first.get(tuple(w[k : k + WINDOW]), i) < i:
                gone.update(range(k, k + WINDOW))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = [[f"p{r.randrange(900)}" for _ in range(r.choice((12, 13, 14, 40)))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [r.choice(("the", "of", f"x{r.randrange(300)}")) for _ in range(r.randrange(0, 70))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        rows.append((i * 3, " ".join(w)))
    return rows


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["h"]) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()), key=str)


def test_whole_table(docs):
    rows = corpus(1)
    rows += [(HUGE, rows[5][1]), (HUGE + 1, rows[5][1]), (None, rows[5][1]), (None, None), (7, None), (8, ""), (10, "a " * 40), (11, "a " * 40), (12, "a " * 40 + "b"), (15, rows[20][1]), (15, rows[21][1]), (16, rows[3][1]), (16, rows[3][1])]
    assert result(remove_repeats(docs(rows))) == brute(rows)


def test_batches_see_what_came_before(spark, docs):
    rows = corpus(2) + [(1000, corpus(2)[4][1])]
    want = {r[0]: r for r in brute(rows)}
    index = FingerprintIndex(spark, 3, fan_in=2)
    for part in (rows[:20], rows[20:35], rows[35:50], [], rows[50:]):
        for r in result(remove_repeats(docs(part), index)):
            assert r == want[r[0]]
    assert len(index.runs) <= 3 and max(level for level, _ in index.runs) == 2  # merged on the way
    index.compact()
    assert len(index.runs) == 1
    tables = {t.name for t in spark.catalog.listTables()}
    index.drop()
    assert len(tables - {t.name for t in spark.catalog.listTables()}) == 1


def test_runs_are_sorted_and_distinct_and_complete(spark, docs):
    rows = corpus(3)
    index = FingerprintIndex(spark, 2)
    index.add(docs(rows))
    pairs = []
    for r in spark.table(index.runs[0][1]).collect():
        keys, checks = _unpack(r["keys"]), _unplanes(r["checks"], np.uint16)
        assert (np.diff(keys.astype(object)) >= 0).all() and (keys >> np.uint64(62) == r["part"]).all()
        pairs += list(zip(keys.tolist(), checks.tolist()))
    keys, checks, _ = windows_of([t for _, t in rows], WordHashes())
    assert sorted(pairs) == sorted(set(zip(keys.tolist(), checks.tolist())))


def test_a_run_is_not_exchanged_by_joins(spark, docs):
    index = FingerprintIndex(spark, 3)
    for part in (corpus(1)[:30], corpus(1)[30:]):
        index.add(docs(part))
    a, b = (spark.table(t) for _, t in index.runs)
    plan = a.select("part", "keys").hint("merge").join(b.select("part", "checks"), "part")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_equal_keys_with_other_checks_are_told_apart():
    u, c = (lambda *x: np.array(x, np.uint64)), (lambda *x: np.array(x, np.uint16))
    keys, checks, least, late, late_keys = _firsts(u(5, 5, 5, 9, 5), c(1, 2, 1, 1, 2), np.array([3, 4, 2, 7, 4]))
    assert list(zip(keys.tolist(), checks.tolist(), least.tolist())) == [(5, 1, 2), (5, 2, 4), (9, 1, 7)] and late.tolist() == [3] and late_keys.tolist() == [5]
    assert _had(u(1, 5, 9), c(1, 2, 1), u(5, 5), c(1, 2)).tolist() == [False, True, False]
    assert _had(u(1, 5), c(1, 3), u(5, 5), c(1, 2)).tolist() == [False, False]
    assert _had(u(1), c(1), u(), c()).tolist() == [False]


def test_many_copies_of_one_text_travel_once():
    texts = [" ".join(f"w{i}" for i in range(40))] * 500
    keys, checks, owner = windows_of(texts, WordHashes())
    sent = _send(keys, checks, owner, 0)
    assert len(_unpack(sent[sent.kind == 0]["keys"].iloc[0])) == 28
    assert sum(len(_unplanes(x, np.uint64)) for x in sent[sent.kind == 1]["keys"]) == 28 * 499


def test_query_is_brute_force_and_its_sql(spark, tmp_path, docs):
    rows = corpus(5, 200) + [(1000, None), (1001, ""), (None, "x " * 30), (2000, corpus(5, 200)[3][1])]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op10_fingerprint_index_repeats(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    assert sorted(con.execute(OP10_SQL).fetchall(), key=str) == [r for r in got if r[0] is not None]
    docs([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op10_fingerprint_index_repeats(spark, f"{tmp_path}/none").count() == 0


def test_empty_table(docs):
    assert remove_repeats(docs([])).count() == 0

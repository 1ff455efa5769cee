import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm.sharding import communication_matrix, hypergeometric, op7_hypergeometric_shards, shuffle_into_shards

from .conftest import HUGE


@pytest.mark.parametrize(("good", "bad", "sample"), [(30, 70, 20), (3_000_000_000, 7_000_000_000, 100_000), (2_000_000_000, 100, 1_000_000_000), (100, 2_000_000_000, 1_000_000_000), (1_000_000_000, 2_000_000_000, 100)])
def test_hypergeometric_has_its_mean_and_spread(good, bad, sample):
    rng = np.random.default_rng(1)
    n = good + bad
    x = np.array([hypergeometric(good, bad, sample, rng) for _ in range(1500)], float)
    mean, sd = sample * good / n, (sample * (good / n) * (bad / n) * (n - sample) / (n - 1)) ** 0.5
    assert abs(x.mean() - mean) < 4 * sd / 1500**0.5 + 1e-6
    assert 0.9 < x.std() / sd < 1.1


def test_matrix_has_its_sums():
    m = np.array(communication_matrix([5, 0, 17, 8], [10, 10, 10], 3))
    assert m.sum(1).tolist() == [5, 0, 17, 8]
    assert m.sum(0).tolist() == [10, 10, 10]


def placed(df, n, **more):
    return shuffle_into_shards(df, n, ["doc_id", "text"], **more).toPandas()


def test_shards_are_exact_gapless_and_complete(docs):
    df = docs([(i, f"t{i}") for i in range(1003)] + [(None, "a"), (None, None), (HUGE, "b"), (7, "t7"), (7, "t7")])
    out = placed(df, 7, block_rows=20)
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(out) == 1008
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (out.text == "t7").sum() == 3 and out.text.isna().sum() == 1
    assert set(out.columns) >= {"row", "key", "rep", "lang"}


def test_shuffle_is_uniform_and_repeatable(docs):
    df = docs([(i, str(i)) for i in range(240)])
    first = placed(df, 4, seed=1).set_index("doc_id")
    assert placed(df.repartition(3), 4, seed=1).set_index("doc_id").slot.sort_index().equals(first.slot.sort_index())
    shards = np.array([placed(df, 4, seed=s).set_index("doc_id").shard.sort_index().to_numpy() for s in range(12)])
    # where a row goes says nothing of where its neighbour goes
    same = (shards[:, 1:] == shards[:, :-1]).mean()
    assert 0.2 < same < 0.3


def test_empty_table(docs):
    assert len(placed(docs([]), 5)) == 0


def test_query_columns_are_those_of_the_texts(spark, docs, tmp_path):
    long = "é long " * 60_000
    rows = [(i, f"text {i % 40}") for i in range(500)] + [(600, None), (601, ""), (602, "日本🙂"), (603, long), (None, "x"), (HUGE, "y"), (5, "text 5"), (5, "text 5")]
    df = docs(rows).withColumn("shard", F.lit(99)).withColumn("slot", F.lit("s")).withColumn("block", F.lit(1)).withColumn("first", F.lit(2))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = op7_hypergeometric_shards(spark, str(tmp_path)).collect()
    data = {(i, t): (t or "").encode() for i, t in rows}
    want = sorted(((i, len(data[i, t]) + 8, zlib.crc32(data[i, t])) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    slots = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(24)}
    assert sum(map(len, slots.values())) == len(rows) and all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    carried = shuffle_into_shards(df, 3, ["doc_id", "text"]).collect()
    assert {r["shard"] for r in carried} == {0, 1, 2} and {(r["block"], r["first"], r["row"]) for r in carried} == {(1, 2, "x")}


def test_rows_move_as_the_matrix_says(spark, docs):
    df = docs([(i, f"t{i}") for i in range(777)])
    block = F.pmod(F.xxhash64(F.lit(5 * 3), "doc_id", "text"), F.lit(16))
    blocks = {r["doc_id"]: r["b"] for r in df.select("doc_id", block.alias("b")).collect()}
    moved = np.zeros((16, 7), int)
    for r in shuffle_into_shards(df, 7, ["doc_id", "text"], seed=5).collect():
        moved[blocks[r["doc_id"]], r["shard"]] += 1
    sizes = [777 // 7 + (s < 777 % 7) for s in range(7)]
    assert moved.tolist() == communication_matrix(moved.sum(1).tolist(), sizes, 5)

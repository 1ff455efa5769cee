"""The index of vectors against the exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tamarack.functions.scoring import cosine
from tamarack.operators import search, vectors as V

SF = "/root/testdata"


def recall(got, want):
    """The share of exact results that are found, or are as good as what is found in their place."""
    least = {}
    for r in want:
        least[r["query_id"]] = min(least.get(r["query_id"], 2.0), r["score"])
    return sum(r["score"] >= least[r["query_id"]] for r in got) / len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_given_tables(spark, tmp_path, sf):
    rows = spark.read.parquet(f"{SF}/{sf}/embeddings.parquet")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = V.write_cells(rows, f"{tmp_path}/i")
    assert spark.read.parquet(f"{index.path}/rows").count() == rows.count()
    want = search.vector_search_batch(rows, queries, 10).collect()
    got = V.cell_search(V.load_cells(spark, index.path), queries, 10).collect()
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in search.vector_search_batch(rows, queries, rows.count()).collect()}
    assert all(exact[r["query_id"], r["vec_id"]] == r["score"] for r in got) and len(got) == len(want)
    assert recall(got, want) >= 0.9


def test_probed_cells_alone_are_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = V.write_cells(df, f"{tmp_path}/i", cells=12)
    queries = df.where("vec_id < 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    few = V.cell_search(index, queries, 10, probes=2)
    assert recall(few.collect(), search.vector_search_batch(df, queries, 10).collect()) >= 0.9
    one = V.cell_search(index, queries.limit(1), 10, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cell), EqualTo(cell," in plan or "In(cell" in plan


def test_rows_without_direction(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [-1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = V.write_cells(df, f"{tmp_path}/i", cells=2)
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, None), (13, [2.0])], "query_id bigint, query array<double>")
    out = {}
    for r in V.cell_search(index, queries, 4, probes=2).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert out[10] == [(1, 1.0), (1, 1.0), (None, 0.995037), (2, 0.0)]
    assert out[11] == out[12] == out[13] == [(None, 0.0), (1, 0.0), (1, 0.0), (2, 0.0)]
    empty = V.write_cells(df.limit(0), f"{tmp_path}/e")
    assert V.cell_search(empty, queries, 3).count() == 0


def test_equal_vectors_come_by_id(spark, tmp_path):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = V.write_cells(df, f"{tmp_path}/i")
    got = V.cell_search(index, spark.createDataFrame([(1, hot)], "query_id bigint, query array<double>"), 10).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(0, 30, 3)) and all(r["score"] == 1.0 for r in got)


def test_exact_search_in_blocks_on_odd_vectors(spark):
    """Nulls, holes, NaN, zeros, other lengths, copies: as the expression scores them, with more queries than a block takes."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)]
    rows += [(300 + i, v) for i, v in enumerate([None, [], [0.0] * 4, [1.0, None, 0.0, 1.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0], [3.0] * 5] + [[1.0, 2.0, 0.0, 1.0]] * 30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 7 = 0 or vec_id >= 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = df.crossJoin(queries).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    want = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 9")
    got = search.vector_search_batch(df, queries, 9, max_queries=20)
    assert got.count() == want.count() == 9 * queries.count() and got.exceptAll(want).count() == 0

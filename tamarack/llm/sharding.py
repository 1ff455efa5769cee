"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks by a hash of their key. The driver knows only how many rows
each block has and draws, from the multivariate hypergeometric law, how many of
them each shard receives; that matrix has the law a uniform permutation of all
rows would give it. Each block is permuted by itself and cut at the drawn
counts, rows are exchanged, and each shard is permuted again. Only DataFrame
functions run on the executors.

Defined cases: an empty table gives no rows; nulls in key columns are values like
any other; rows that are equal in every key column are interchangeable, and each
gets a slot of its own; further columns, whatever their names, are carried along
unless they have the names of the columns added (``shard``, ``slot``), which are
replaced.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read

#: Rows that one task sorts at most, about; the number of blocks follows from it.
BLOCK_ROWS = 500_000


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """How many of ``sample`` draws without replacement are good; exact for counts of any size."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    if min(good, bad, sample, good + bad - sample) < 1000:
        # few of one kind: one draw after another, for the smallest of the four counts
        least = min(good, bad, sample, good + bad - sample)
        if least == bad:
            return sample - hypergeometric(bad, good, sample, rng)
        if least == good + bad - sample:
            return good - hypergeometric(good, bad, good + bad - sample, rng)
        if least == good:
            return hypergeometric(sample, good + bad - sample, good, rng) if sample != good else _one_by_one(good, bad, sample, rng)
        return _one_by_one(good, bad, sample, rng)
    # rejection from a two-sided exponential envelope around the mode
    total = good + bad
    log_p = lambda k: -sum(math.lgamma(v + 1) for v in (k, good - k, sample - k, bad - sample + k))
    mode = (sample + 1) * (good + 1) // (total + 2)
    sd = math.sqrt(sample * (good / total) * (bad / total) * (total - sample) / (total - 1))
    low, high = max(0, sample - bad), min(good, sample)
    top, width = log_p(mode), sd * 1.2
    while True:
        step = int(rng.exponential(width)) * (1 if rng.random() < 0.5 else -1)
        k = mode + step
        # the envelope exp(|step| / width - 1) is above the law's log-concave shape
        if low <= k <= high and math.log(max(rng.random(), 1e-300)) <= log_p(k) - top + abs(step) / width - 1:
            return k


def _one_by_one(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    found = 0
    for i in range(sample):
        found += int(rng.random() * (good + bad - i)) < good - found
    return found


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, with the law of a uniform permutation."""
    rng = np.random.default_rng(seed)
    left = list(columns)
    out = []
    for n in rows:
        total, line = sum(left), []
        for c in left:
            k = hypergeometric(c, total - c, n, rng) if n else 0
            line.append(k)
            n -= k
            total -= c
        left = [a - b for a, b in zip(left, line, strict=True)]
        out.append(line)
    return out


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of the plan, as a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def shuffle_into_shards(df: DataFrame, n_shards: int, key: list[str | Column], seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with ``shard`` int and ``slot`` bigint: a uniform shuffle, shard sizes at most one apart.

    ``key`` names the columns that tell rows apart. The first rows of the shards
    by number get the rows left over by the division.
    """
    spark = df.sparkSession
    total = df.count()
    blocks = max(16, -(-total // block_rows))
    parts = max(1, -(-total // (n_shards * block_rows)))
    salted = lambda k: F.xxhash64(F.lit(seed * 3 + k), *key)
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    # the row's own columns travel in one, so that no name of theirs meets one of ours
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")
    keyed = df.select(F.pmod(salted(0), F.lit(blocks)).alias("block"), salted(1).alias("first"), salted(2).alias("second"), F.struct(*key).alias("key"), row)

    found = {r["block"]: r["n"] for r in keyed.groupBy("block").agg(F.count("*").alias("n")).collect()}
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    drawn = communication_matrix([found.get(b, 0) for b in range(blocks)], sizes, seed)
    matrix = _table(spark, [{"block": b, "upto": np.cumsum(line).tolist()} for b, line in enumerate(drawn)], "block:bigint,upto:array<bigint>")

    local = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("first", "key")))
    sent = local.join(matrix, "block").select(F.size(F.filter("upto", lambda c: c < F.col("rank"))).cast("int").alias("shard"), "second", "key", "row")
    # part of a shard: an interval of the second hash, so that parts in order are the shard in order
    sent = sent.withColumn("part", F.shiftright(F.shiftrightunsigned("second", 33) * F.lit(parts), 31))
    before = sent.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = sent.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("second", "key")))
    return ranked.join(before, ["shard", "part"]).select(*(F.col("row")[c].alias(c) for c in rest), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    digest = read(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"))
    placed = shuffle_into_shards(digest, 24, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Best-fit packing planned on a histogram of lengths.

Documents become token pieces; the planner sees only how many pieces there are
of each length (at most ``max_tokens`` counts), places whole counts by best fit,
longest first, and writes its plan as rank intervals. Pieces then take the
planned places by a join on length and rank within the length.

Defined cases: null or empty text is the end token alone; an empty table gives no
rows; repeated rows are packed each on its own; null ids are values like any
other; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import map_frames, materialize, read, short_batches

MAX_TOKENS = 1024
END_ID = 2
#: Pieces of one length and salt that one window sorts: about a SALT_SHARE-th of all, between these bounds.
SALT_SHARE, SALT_ROWS = 4096, (256, 500_000)
#: Rows of the plan up to which it is broadcast (it has at most max_tokens ** 2 / 2, usually a few thousand).
PLAN_ROWS = 200_000


@functools.cache
def tokenizer(name: str):
    """text -> ids of the byte-level BPE vocabulary ``name``, special strings as their ids.

    tiktoken gives the same ids from the same vocabulary several times faster
    (tests compare the two); tokenizers itself encodes what tiktoken refuses.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken")) as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, file)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except Exception:  # very long runs overflow its regex stack
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``, little-endian uint32, on demand).

    A document of more than ``max_tokens`` ids is cut into full pieces; what
    doesn't fill one comes first.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(name)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[id_col].array, pdf[text_col].array, strict=True):
                ids = np.array([*(encode(text) if isinstance(text, str) and text else ()), end_id], "<u4")
                start, end = 0, len(ids) % max_tokens or max_tokens
                for piece in range(-(-len(ids) // max_tokens)):
                    data = ids[start:end].tobytes()
                    rows.append((key, piece, start, end - start, zlib.crc32(data), data))
                    start, end = end, end + max_tokens
            out = pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", "ids"], dtype=object)
            yield out if keep_ids else out.drop(columns="ids")

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).transform(map_frames, cut, schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[dict]:
    """Places for ``counts[length]`` pieces of each length, as rank intervals.

    A row says: pieces of ``length`` with ranks in [lo, hi) go ``each`` to a
    sequence, from sequence ``base`` on and from token ``at`` on. Best fit takes
    the sequence with the least room that suffices; equal pieces fill that
    sequence before another, so whole groups of equal sequences are served at once.
    """
    plan: list[dict] = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room -> (first sequence, how many)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room < capacity and not rooms[room]:
                room += 1
            if room >= capacity:
                each = capacity // length
                base, many = opened, -(-left // each)
                opened += many
                free = capacity
            else:
                each, free = room // length, room
                base, many = rooms[room].pop()
            full = min(many, left // each)
            at = capacity - free
            if full:
                plan.append({"length": length, "lo": rank, "hi": rank + full * each, "each": each, "base": base, "at": at})
                rooms[free - each * length].append((base, full))
                rank, left, base, many = rank + full * each, left - full * each, base + full, many - full
            if many and left and left < each:
                plan.append({"length": length, "lo": rank, "hi": rank + left, "each": left, "base": base, "at": at})
                rooms[free - left * length].append((base, 1))
                rank, left, base, many = rank + left, 0, base + 1, many - 1
            if many:
                rooms[free].append((base, many))
    return plan


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``. ``pieces`` is read more than once: pass a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(counts, max_tokens)
    window = min(max(sum(counts.values()) // SALT_SHARE, SALT_ROWS[0]), SALT_ROWS[1])
    salts = max(1, -(-max(counts.values(), default=0) // window))
    by_length = [{"length": length, "places": list(rows)} for length, rows in itertools.groupby(plan, lambda p: p["length"])]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(by_length)), "array<struct<length:bigint,places:array<struct<lo:bigint,hi:bigint,each:bigint,base:bigint,at:bigint>>>>")).alias("p")).select("p.*")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # a row for each length: a piece meets its length's intervals as an array, not as rows
    placed = ranked.join(F.broadcast(table) if len(plan) <= PLAN_ROWS else table, "length")
    placed = placed.withColumn("_place", F.get(F.filter("places", lambda p: (F.col("_rank") >= p["lo"]) & (F.col("_rank") < p["hi"])), F.lit(0)))
    step, each = F.col("_rank") - F.col("_place.lo"), F.col("_place.each")
    return placed.select(*pieces.columns, (F.col("_place.base") + F.floor(step / each)).cast("bigint").alias("sequence_id"), (F.col("_place.at") + step % each * F.col("length")).alias("offset"))


def packed_documents(docs: DataFrame) -> DataFrame:
    short_batches(docs.sparkSession)
    pieces = materialize(token_pieces(docs), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed_documents(read(spark, sf_dir, "documents"))

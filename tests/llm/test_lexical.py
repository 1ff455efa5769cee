import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm import lexical as L

from .conftest import HUGE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for (doc, _), ts in zip(docs, terms, strict=True):
            tf, score = Counter(ts), 0
            for t, r in wanted.items():
                if tf[t]:
                    m = 100 - 25 + (25 * len(ts) * n) // total
                    score += r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    words = ["The", "thing", "of", "ÄPFEL", "äpfel", "a1", "x_y", "naïve", "中文", "zz", "rare"]
    docs = [(i, r.choice([" ", "-", "\n", "_"]).join(r.choice(words[: r.randrange(3, 11)]) for _ in range(r.randrange(1, 30)))) for i in range(250)]
    docs += [(1000 + i, "the same thing") for i in range(60)] + [(900 + i, "the same thing") for i in range(5)]
    docs += [(300, None), (301, ""), (302, " -_\x7f"), (HUGE, "rare thing"), (None, "rare thing"), (3, "rare thing"), (400, "of " * 5000 + "rare")]
    r.shuffle(docs)
    items = [(1, "The thing of the thing"), (2, "rare"), (3, "same"), (4, None), (5, "!!"), (6, "nowhere"), (7, "ÄPFEL 中文"), (1, "a1 rare"), (None, "zz")]
    return docs, items


def search(docs, spark, rows, items, k, shards=3):
    queries = spark.createDataFrame([(i, t, 1, "c") for i, t in items], "item_id bigint, text string, doc_id int, score string")
    out = L.lexical_search(docs(rows).repartition(shards), queries, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


def test_ranks_are_those_of_all_documents(docs, spark):
    rows, items = corpus()
    for k in (1, 7, 20):
        assert search(docs, spark, rows, items, k) == brute(rows, items, k)


def test_shards_and_blocks_of_any_size(docs, spark, monkeypatch):
    rows, items = corpus()
    for name, value in (("SHARD_DOCS", 9), ("SHARD_POSTINGS", 30), ("BLOCK_TERMS", 3), ("MERGES", 2)):
        monkeypatch.setattr(L, name, value)
    assert search(docs, spark, rows, items, 5) == brute(rows, items, 5)


def test_equal_scores_keep_the_smallest_ids():
    scores, ids = np.array([5, 7, 5, 5, 0, 5, 9]), np.array([4, 9, 1, 0, 2, 3, 8])
    absent = np.array([0, 0, 0, 1, 0, 0, 0])
    for k in range(1, 8):
        want = sorted((i for i in range(7) if scores[i]), key=lambda i: (-scores[i], absent[i], ids[i]))[:k]
        assert set(L.best(scores, absent, ids, k)) == set(want)


def test_empty_tables(docs, spark):
    assert search(docs, spark, [], [(1, "a")], 3) == [] and search(docs, spark, [(1, "a")], [], 3) == []


def test_impacts_of_very_large_corpora():
    got = L.impacts(np.array([1, 3]), np.array([10**9, 5]), 10**11, 10**12)
    assert got.tolist() == [10**9 // (1000 + 12 * (75 + 25 * 10**9 * 10**11 // 10**12)), 3 * 10**9 // (3000 + 12 * (75 + 25 * 5 * 10**11 // 10**12))]


def test_the_corpus_is_read_once_for_a_block(docs, spark):
    rows, _ = corpus()
    vocabulary = {b"thing": 0, b"rare": 1}
    index = L.shards(docs(rows).coalesce(1).select(F.col("doc_id").alias("id"), "text"), vocabulary)
    assert index.count() == 1
    n, total, found = L.document_frequencies(index, 2)
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in rows]
    assert (n, total) == (sum(map(bool, terms)), sum(map(len, terms))) and found.tolist() == [sum(w in t for t in terms) for w in ("thing", "rare")]

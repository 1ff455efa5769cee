"""Ranked lexical search: all documents against a stated set of queries, exactly.

Documents lie in shards of some thousand, as compressed sparse rows: for each term of
the queries the shard's documents that hold it and how often. Once the whole corpus's
counts are known, each posting's share of a score is computed as an integer (its
impact) and written with the shard. A search goes term at a time: a query's postings
are added to a dense array of the shard's documents, and the best of it are taken by
partition, equal scores by ascending id. A task keeps the best of all its shards, and
the tasks' lists are merged in two steps.

Queries are searched in blocks of a bounded number of terms, so what goes to all tasks
is bounded; a corpus is read once for each block. Postings of words that no query of
the block has would never be read and aren't made; counts are of whole texts.

Defined cases: a null or empty text has no terms and is never found; rows that share an
id are documents of their own; rows without an id come last among equal scores; queries
that share an id are one, with the terms of all their rows; one without terms finds
nothing; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import map_frames, materialize, read, short_batches

#: Fixed values of the ranking: part of a score that the length of a document decides (percent), and scales.
LENGTH_SHARE, SATURATION, SCALE, WEIGHT_SCALE = 25, 12, 1_000_000_000, 1000
#: Documents, and postings, after which a shard is closed.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 20
#: Distinct (query, term) pairs of a block of queries, about.
BLOCK_TERMS = 200_000
#: Parts in which the tasks' lists of a query are merged first.
MERGES = 32

#: Bytes of terms, A-Z in lower case; all others become blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SHARDS = "docs int, terms_total bigint, ids binary, without_id binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def terms_of(text: str | None) -> list[bytes]:
    r"""Maximal runs of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]``, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if isinstance(text, str) else []


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query, term (binary), repeats; written."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, t, n) for q, text in zip(pdf["query"], pdf["text"], strict=True) for t, n in Counter(terms_of(text)).items()]
            yield pd.DataFrame(rows, columns=["query", "term", "n"])

    each = queries.select(F.col(id_col).cast("bigint").alias("query"), F.col(text_col).alias("text")).transform(map_frames, run, "query bigint, term binary, n bigint")
    return materialize(each.groupBy("query", "term").agg(F.sum("n").alias("repeats")), "queries")


def shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Compressed sparse rows of the vocabulary's terms in all documents (id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, keys, counts, n_docs, n_postings, total = [], [], [], [], 0, 0, 0

        def shard() -> pd.DataFrame:
            # postings were made by document; by term, then by document is their order in the shard
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            term, place, count = (key[order] >> 32).astype("<i4"), (key[order] & 0xFFFFFFFF).astype("<i4"), count[order].astype("<i8")
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
            own, absent = np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "u1")
            row = (n_docs, total, own.tobytes(), absent.tobytes(), np.array(lengths, "<i8").tobytes(), term[starts].tobytes(), np.r_[starts, len(term)].astype("<i8").tobytes(), place.tobytes(), count.tobytes())
            return pd.DataFrame([row], columns=[f.split()[0] for f in SHARDS.split(", ")])

        get = vocabulary.get
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                words = terms_of(text)
                if not words:
                    continue  # has no score, and isn't counted
                known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                term, count = np.unique(known[known >= 0], return_counts=True)
                keys.append(term << 32 | n_docs)
                counts.append(count)
                ids.append(None if pd.isna(i) else int(i))
                lengths.append(len(words))
                n_docs, n_postings, total = n_docs + 1, n_postings + len(term), total + len(words)
                if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                    yield shard()
                    ids, lengths, keys, counts, n_docs, n_postings, total = [], [], [], [], 0, 0, 0
        if n_docs:
            yield shard()

    return docs.transform(map_frames, run, SHARDS)


def document_frequencies(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms with repeats, documents of each vocabulary term)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, docs, total = np.zeros(terms, np.int64), 0, 0
        for pdf in batches:
            for row in pdf.itertuples():
                found[np.frombuffer(row.terms, "<i4")] += np.diff(np.frombuffer(row.starts, "<i8"))
                docs, total = docs + row.docs, total + row.terms_total
        at = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.r_[-2, -1, at], "n": np.r_[docs, total, found[at]]})

    # at most as many rows as the block of queries has terms
    counted = index.select("docs", "terms_total", "terms", "starts").transform(map_frames, run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    every = dict(zip(counted.term, counted.n, strict=True))
    return int(every.get(-2, 0)), int(every.get(-1, 0)), np.array([every.get(i, 0) for i in range(terms)], np.int64)


def weight(docs: int, frequency: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * docs + 2) / (2 * frequency + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A posting's share of a score, from the term's count and the document's length."""
    # Python's integers for each distinct length: the product of length and number of documents may pass 64 bits
    distinct, at = np.unique(lengths, return_inverse=True)
    m = np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * int(n) * docs) // total for n in distinct], np.int64)[at]
    return (SCALE * counts) // (1000 * counts + SATURATION * m)


def with_impacts(index: DataFrame, docs: int, total: int) -> DataFrame:
    """The shards with an impact for each posting in place of its count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [impacts(np.frombuffer(r.counts, "<i8"), np.frombuffer(r.lengths, "<i8")[np.frombuffer(r.places, "<i4")], docs, total).astype("<i4").tobytes() for r in pdf.itertuples()]
            yield pdf[["docs", "ids", "without_id", "terms", "starts", "places"]].assign(impacts=made)

    return index.transform(map_frames, run, "docs int, ids binary, without_id binary, terms binary, starts binary, places binary, impacts binary")


def best(scores: np.ndarray, absent: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores; of equal ones those with the smallest ids, rows without an id last."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        have = scores[found]
        least = have[np.argpartition(have, len(have) - k)[len(have) - k]]
        above, equal = found[have > least], found[have == least]
        free = k - len(above)
        if len(equal) > free:
            # the ids decide between equal scores: all of them compete, not those that partitioning happened to leave
            equal = equal[np.lexsort((ids[equal], absent[equal]))[:free]]
        found = np.concatenate([above, equal])
    return found


def search_shards(index: DataFrame, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int) -> DataFrame:
    """number, task, doc, score: for each task, each query's best of its shards.

    Query i has the terms and weights (repeats included) of the slice ends[i] to ends[i + 1].
    """
    shared = index.sparkSession.sparkContext.broadcast((terms, weights, ends))  # a block of queries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, weights, ends = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for row in pdf.itertuples():
                ids, absent, starts = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.without_id, "u1"), np.frombuffer(row.starts, "<i8")
                own, places, shares = np.frombuffer(row.terms, "<i4"), np.frombuffer(row.places, "<i4"), np.frombuffer(row.impacts, "<i4")
                at = np.searchsorted(own, terms)
                here = np.flatnonzero(at < len(own))
                here = here[own[at[here]] == terms[here]]
                query = np.searchsorted(ends, here, side="right") - 1
                scores = np.empty(row.docs, np.int64)
                for chunk in np.split(here, np.flatnonzero(np.diff(query)) + 1) if len(here) else ():
                    number = int(np.searchsorted(ends, chunk[0], side="right") - 1)
                    scores[:] = 0
                    for t in chunk:  # a document is once in a term's postings
                        a, b = starts[at[t]], starts[at[t] + 1]
                        scores[places[a:b]] += weights[t] * shares[a:b].astype(np.int64)
                    top = best(scores, absent, ids, k)
                    mine = scores[top], absent[top], ids[top]
                    if number in kept:
                        mine = tuple(np.concatenate(pair) for pair in zip(kept[number], mine, strict=True))
                        top = best(*mine, k)
                        mine = tuple(column[top] for column in mine)
                    kept[number] = mine
        for number, (score, absent, ids) in kept.items():
            yield pd.DataFrame({"number": number, "doc": pd.Series(ids, dtype="Int64").mask(absent.astype(bool)), "score": score})

    return index.transform(map_frames, run, "number int, doc bigint, score bigint").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """query id, rank, doc id, score: the k best documents of each query."""
    spark = docs.sparkSession
    short_batches(spark)
    asked = query_terms(queries, query_id_col, query_text_col)
    corpus = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    pieces = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    found: DataFrame | None = None
    for piece in range(pieces):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(pieces)) == piece).orderBy("query", "term").toPandas()
        numbers, names = pd.factorize(block["query"], use_na_sentinel=False)
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for t in block["term"]}))}
        index = materialize(shards(corpus, vocabulary), "shards")
        n, total, frequencies = document_frequencies(index, len(vocabulary))
        terms = np.array([vocabulary[bytes(t)] for t in block["term"]], np.int64)
        weights = np.array([weight(n, int(f)) for f in frequencies], np.int64)[terms] * block["repeats"].to_numpy(np.int64) if len(terms) else np.empty(0, np.int64)
        ends = np.searchsorted(numbers, np.arange(len(names) + 1))
        scored = materialize(with_impacts(index, n, max(total, 1)), "impacts")
        lists = search_shards(scored, terms, weights, ends, k)
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        lists = lists.withColumn("place", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).where(F.col("place") <= k)
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, None if pd.isna(q) else int(q)) for i, q in enumerate(names)], f"number int, `{query_id_col}` bigint")
        top = materialize(lists.join(F.broadcast(ids), "number").select(query_id_col, "rank", F.col("doc").alias(id_col), "score"), "top")
        found = top if found is None else found.unionByName(top)
    return found


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each item of the benchmark."""
    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 20)


#: The same in DuckDB's SQL.
OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ts FROM documents),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM benchmark) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c WHERE t IN (SELECT t FROM q) GROUP BY t, n),
i AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(ts) * n) // l)) AS impact FROM p JOIN d USING (r), c WHERE t IN (SELECT t FROM q)),
s AS (SELECT item_id, r, CAST(sum(k * w * impact) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN i USING (t) GROUP BY 1, 2),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20"""

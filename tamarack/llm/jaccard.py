"""Similarity join of texts by their shingles: token combinations in extended prefixes, exactly.

A document is its set of k-word shingles (64-bit hashes, as in ``neardup``). Two sets
of sizes n and m with a similarity of at least t have at least ceil(t n) and ceil(t m)
elements in common, so each lacks at most d = n - ceil(t n) of its own.

1. Documents of equal sets are one class; the search is between classes.
2. In the order of hashes, a prefix of d + j elements holds the pair's first j common
   elements. Each class keeps such an extended prefix with j = d + 2: two linked
   classes share at least that many elements of their prefixes (the smaller set's j).
   For a similarity of 0.8 that is four tenths of a set; the rest isn't counted.
3. How many classes have each element in their prefix is counted, and elements that
   no other has are dropped. A class whose remaining elements are fewer than the j of
   the smallest set it can be linked with has no partner.
4. The prefix is sorted anew, rarest elements first, and only as much of it is indexed
   as must hold two elements of each link. A rare element is a key of its own. Frequent
   ones are keys in combinations of two, so that an element that many unrelated
   documents hold (a line of a licence) brings none of them together. If one of a
   link's first two common elements is rare, it is their key; else their combination
   is. Where combinations would be many (a long text of nothing but frequent
   elements) its elements are keys of their own, for all who have them.
5. Each key has a pivot, its member that meets most others; members are held against
   it, then those that the pivot can't have for a partner against all of the key, in
   blocks. A pair may be linked if the sizes allow it and the extended prefixes share
   enough (2): no link is lost here. Blocks return spanning forests, never all pairs.
6. Possible pairs make clusters; links are confirmed within these on full sets, and
   components of links are labelled with their smallest id.

Defined cases: null or blank texts have no shingles and no links; rows that share an
id are one document, whose links are united, and each row is returned; a row without
an id is not linked and has a null component; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WordHashes, connected_components, discard, lower_words_of, map_frames, materialize, per_sorted_group, read, scratch, shingle_set, short_batches
from .neardup import _blocks, _common_counts, _edges, _spanning, confirmed_links

#: Classes with an element up to which it is rare, and frequent elements of a class up to which they are combined.
RARE, COMBINED = 4, 24
#: Members of a block, and elements of its prefixes, about.
BLOCK, BLOCK_ELEMENTS = 1024, 4_000_000


def needed(n, num: int, den: int):
    """Elements that a set of size n has in common with each partner, at least: ceil(num * n / den)."""
    return (num * n + den - 1) // den


def shared_at_least(n, num: int, den: int):
    """Elements that the extended prefix of a set of size n has in common with that of a partner that isn't smaller."""
    need = needed(n, num, den)
    return np.minimum(n - need + 2, need)


def _needed(n: Column, num: int, den: int) -> Column:
    return F.floor((n * num + (den - 1)) / den)


def _shared_at_least(n: Column, num: int, den: int) -> Column:
    return F.least(n - _needed(n, num, den) + 2, _needed(n, num, den))


def prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """id, n, h1, h2, prefix: size, 128-bit identity and extended prefix of each row's shingles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            sets = [shingle_set(hashes.of(lower_words_of(t if isinstance(t, str) else None)), k) for t in pdf[text_col]]
            yield pd.DataFrame({
                "id": pdf["id"],
                "n": [len(s) for s in sets],
                "h1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64),
                "h2": np.array([(s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64),
                "prefix": [s[: len(s) - needed(len(s), num, den) + shared_at_least(len(s), num, den)].tobytes() if len(s) else None for s in sets],
            })

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).transform(map_frames, run, "id bigint, n bigint, h1 bigint, h2 bigint, prefix binary")


def elements(classes: DataFrame) -> DataFrame:
    """class, element of each prefix."""
    schema = pa.schema([("class", pa.int64()), ("element", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, prefix in zip(batch.column("class").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                made = np.frombuffer(prefix, "<i8")
                for at in range(0, len(made), 65_536):
                    part = made[at : at + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(part)], schema=schema)

    return classes.select("class", "prefix").mapInArrow(run, "class bigint, element bigint")


def keys_of(indexed: DataFrame, rare: int = RARE, combined: int = COMBINED) -> DataFrame:
    """class, key from the indexed elements (class, element, one): rare ones alone, frequent ones in twos.

    ``one``: the class can be linked with one that shares a single element with it.
    """
    posts = indexed.groupBy("element").agg(F.count("*").alias("posts")).where("posts > 1")
    known = materialize(indexed.join(posts, "element"), "indexed")
    frequent = known.where(F.col("posts") > rare)
    many = frequent.groupBy("class").agg(F.count("*").alias("frequent"), F.max("one").alias("one")).where((F.col("frequent") > combined) | F.col("one")).select("class")
    # an element is combined in all classes or in none: it must lead its classes together either way
    alone = frequent.join(many, "class", "left_semi").select("element").distinct()
    single = known.where(F.col("posts") <= rare).select("class", "element").unionByName(frequent.join(alone, "element", "left_semi").select("class", "element"))
    twos = frequent.join(alone, "element", "left_anti").groupBy("class").agg(F.array_sort(F.collect_list("element")).alias("e"))  # ``combined`` at most
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.xxhash64(F.lit(2), x, y))))
    return single.select("class", F.xxhash64(F.lit(1), "element").alias("key")).unionByName(twos.select("class", F.explode(pairs).alias("key")))


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in column]


def _possible(q: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes whose extended prefixes share q elements can be linked."""
    less, more = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (den * less >= num * more) & (q >= shared_at_least(less, num, den))


def _judge_pairs(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """src, dst, possible of rows with the sizes and prefixes of both."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(_arrays(pdf.prefix_a), _arrays(pdf.prefix_b), strict=True)], np.int64)
            yield pdf[["src", "dst"]].assign(possible=_possible(q, pdf.n_a.to_numpy(), pdf.n_b.to_numpy(), num, den))

    return pairs.transform(map_frames, run, "src bigint, dst bigint, possible boolean")


def _possible_block(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    q = _common_counts(_arrays(left.prefix), _arrays(right.prefix))
    adjacent = _possible(q, left.n.to_numpy()[:, None], right.n.to_numpy()[None], num, den)
    return _edges(*_spanning(adjacent, left.rep.to_numpy(), right.rep.to_numpy()))


def possible_pairs(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, dst) of classes (class, n, prefix) with pivots, and others: together they connect all that is linked."""
    counted = materialize(elements(classes).groupBy("element").agg(F.count("*").alias("classes")).where("classes > 1"), "counted")
    # one element may be in very many classes: rows of the join are dealt anew by Spark where they are
    met = elements(classes).join(counted, "element").join(classes.select("class", "n"), "class")
    floor = _shared_at_least(_needed(F.col("n"), num, den), num, den)
    rank = F.expr("row_number() over (partition by class order by classes, element)")
    ranked = met.select("class", "n", "element", rank.alias("rank"), F.expr("count(*) over (partition by class)").alias("met"))
    kept = materialize(ranked.where(F.col("met") >= floor).select("class", "n", "element", (F.col("rank") <= F.col("met") - floor + 2).alias("indexed"), (floor < 2).alias("one")), "kept")
    body = materialize(kept.groupBy("class", "n").agg(F.array_sort(F.collect_list("element")).alias("prefix"), F.count("*").alias("weight")).withColumnRenamed("class", "rep"), "body")

    keys = materialize(keys_of(kept.where("indexed").select("class", "element", "one")).withColumnRenamed("class", "rep"), "keys")
    members = materialize(keys.join(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "members")
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    pivots = members.join(degree, "rep").groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("pivot"))
    star = materialize(members.join(pivots, "key").where("rep <> pivot").select("key", "rep", "pivot"), "star")

    of = lambda side: body.select(F.col("rep").alias("src" if side == "a" else "dst"), F.col("n").alias(f"n_{side}"), F.col("prefix").alias(f"prefix_{side}"))
    pairs = star.select(F.col("rep").alias("src"), F.col("pivot").alias("dst")).distinct()
    judged = materialize(_judge_pairs(pairs.join(of("a"), "src").join(of("b"), "dst"), num, den), "judged")
    doubtful = materialize(star.join(judged.where("not possible").select(F.col("src").alias("rep"), F.col("dst").alias("pivot")), ["rep", "pivot"]).select("key", "rep"), "doubtful")
    rest, every = doubtful.join(body, "rep"), members.join(doubtful.select("key").distinct(), "key", "left_semi").select("key", "rep").join(body, "rep")

    def compare(_: tuple, group: pd.DataFrame) -> pd.DataFrame | None:
        left, right = group[group.is_left], group[~group.is_left]
        return _possible_block(left, right, num, den) if len(left) and len(right) else None

    found = per_sorted_group(_blocks(rest, every, "key", BLOCK, ["n", "prefix"], F.col("weight"), BLOCK_ELEMENTS), ["key", "i", "j"], compare, "src bigint, dst bigint")
    return judged.where("possible").select("src", "dst"), found


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id: components of links with den * |A & B| >= num * |A | B|."""
    spark = docs.sparkSession
    short_batches(spark)
    whole = f"{scratch(spark)}/prefixes"
    prefixes(docs, id_col, text_col, k, num, den).write.parquet(whole)
    rows = spark.read.parquet(whole)
    feat = materialize(rows.select("id", "n", "h1", "h2"), "sizes")
    # rows that share an id may be of several classes, so classes have numbers of their own
    groups = rows.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("least"), F.any_value("prefix").alias("prefix"))
    classes = materialize(groups.withColumn("class", F.monotonically_increasing_id()), "classes")
    discard(spark, whole)
    with_pivots, others = possible_pairs(classes, num, den)

    def of_ids(pairs: DataFrame) -> DataFrame:
        for side in ("src", "dst"):
            pairs = pairs.join(classes.select(F.col("class").alias(side), F.col("least").alias("_least")), side).drop(side).withColumnRenamed("_least", side)
        return pairs.select("src", "dst")

    seen = materialize(of_ids(with_pivots), "seen")
    clusters = connected_components(seen.unionByName(of_ids(others)))
    links = confirmed_links(docs, clusters, seen, id_col, text_col, k, num, den)
    named = materialize(feat.join(classes.select("n", "h1", "h2", "least"), ["n", "h1", "h2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("least")), "named")
    repeated = named.where("id is not null").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    united = named.join(repeated, "id", "left_semi").where("id <> least").select(F.col("id").alias("src"), F.col("least").alias("dst"))
    labels = connected_components(links.unionByName(united)).withColumnRenamed("node", "least")
    return named.join(labels, "least", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "least").alias("component_id"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a similarity of 0.8 or more."""
    return similarity_join(read(spark, sf_dir, "documents"))


#: The same in DuckDB's SQL, by comparing all pairs that share a shingle.
OP13_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 3, 2) END), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN m USING (doc_id)"""

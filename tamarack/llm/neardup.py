"""Near duplicates by SetSketch registers, and components of exact links.

A document is its set of k-word shingles, each a 64-bit hash (two shingles of one
text collide with a chance of about n^2 / 2^65). Sets become SetSketch registers:
register i is the truncated integer 1 - log_b of the smallest of the set's
exponentially distributed hashes. Registers of equal sets are equal, registers of
a union are the maxima, and two sets agree in a register about as often as their
Jaccard similarity says.

Search, in steps that are linear in the rows of any group:

1. Rows of equal sets are one class; the smallest id stands for it.
2. Bands of registers make buckets. Each bucket has a pivot, its member that
   meets most others over all buckets; members are compared with it by joint
   likelihood of their registers and cardinalities. Those the pivot can't vouch
   for are compared, blockwise, with the whole bucket; blocks return a spanning
   forest of likely pairs, never all of them.
3. Likely pairs join classes to clusters, so any true link of a bucket lies
   within one cluster. Links are confirmed there on full sets: small clusters at
   once; members of large ones with the cluster's centre, then blocks of the rest
   against all. Blocks again return spanning forests.
4. Components of the confirmed links are labelled with their smallest id.

What can be lost: a link that no band finds (1.2e-5 at a similarity of exactly
0.85, less above), or whose likelihood estimate is off by over five deviations.

Defined cases: null or blank texts have no shingles and no links; rows that share
an id are one document, whose links are united, and each row is returned; a row
without an id is not linked, has a null component and is kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WordHashes, connected_components, lower_words_of, map_frames, materialize, per_sorted_group, read, shingle_set, short_batches

#: SetSketch parameters: base, rate, and the largest register value of 16 bits.
BASE, RATE, TOP = 1.001, 20.0, 65535
REGISTERS = 144
#: Members of a block when registers or full sets are compared, and bytes of its full sets, about.
SKETCH_BLOCK, SET_BLOCK, SET_BYTES = 1024, 256, 32 << 20
#: Deviations below the threshold at which an estimate rules a pair out.
SLACK = 5.0


def bands_for(threshold: float, registers: int = REGISTERS, miss: float = 2e-5) -> tuple[int, int]:
    """(rows of a band, bands): the longest bands that lose at most ``miss`` of the pairs at the threshold."""
    fitting = [(r, registers // r) for r in range(1, registers + 1) if (1 - threshold**r) ** (registers // r) <= miss]
    return max(fitting)


def _salts(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2021)
    return rng.integers(0, 1 << 31, m, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 31, m, np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(shingles: np.ndarray, salts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Registers of a non-empty set of 64-bit hashes."""
    a, b = salts
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        y = np.multiply.outer(low[at : at + 1024], a)
        y += np.multiply.outer(high[at : at + 1024], b)
        np.minimum(least, y.min(axis=0), out=least)
    h = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, TOP).astype("<u2")


def merge(*registers: np.ndarray) -> np.ndarray:
    """Registers of a union."""
    return np.maximum.reduce(registers)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log(1 - x * (BASE - 1) / BASE) / math.log(BASE)


def likelihood_slope(greater, less, equal, n_a, n_b, j: float) -> np.ndarray:
    """Slope, at similarity j, of the joint log-likelihood of two sketches with known set sizes.

    The likelihood is concave, so a slope of at least 0 says that its maximum is
    at j or above. j must be below the ratio of the sizes.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    x, y = u - v * j, v - u * j
    up, down = _p(x), _p(y)
    rate = (BASE - 1) / BASE / math.log(BASE)
    dx, dy = rate / (1 - x * (BASE - 1) / BASE), rate / (1 - y * (BASE - 1) / BASE)
    same = np.maximum(1 - up - down, 1e-12)
    return -greater * v * dx / up - less * u * dy / down + equal * (v * dx + u * dy) / same


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of register rows may reach the threshold."""
    m = a.shape[-1]
    floor = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / m)
    fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    equal = (a == b).sum(-1)
    out = np.zeros(fits.shape, bool)
    if (at := np.flatnonzero(fits)).size:
        greater = (a[at] > b[at]).sum(-1)
        out[at] = likelihood_slope(greater, m - greater - equal[at], equal[at], n_a[at], n_b[at], floor) >= 0
    return out


def _spanning(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a bipartite graph, as pairs of ids."""
    src, dst = [], []
    open_l, open_r = np.ones(len(left), bool), np.ones(len(right), bool)
    for start in range(len(left)):
        if not open_l[start]:
            continue
        open_l[start] = False
        front = np.array([start])
        while front.size:
            reached = np.flatnonzero(open_r & adjacent[front].any(axis=0))
            if not reached.size:
                break
            open_r[reached] = False
            src.append(right[reached])
            dst.append(left[front[adjacent[np.ix_(front, reached)].argmax(axis=0)]])
            front = np.flatnonzero(open_l & adjacent[:, reached].any(axis=1))
            open_l[front] = False
            if front.size:
                src.append(left[front])
                dst.append(right[reached[adjacent[np.ix_(front, reached)].argmax(axis=1)]])
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.empty(0, left.dtype), np.empty(0, left.dtype))


def _edges(src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
    apart = src != dst
    return pd.DataFrame({"src": src[apart], "dst": dst[apart]})


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


def _likely_block(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    a, b = _registers(left.regs), _registers(right.regs)
    m = a.shape[1]
    equal = np.zeros((len(a), len(b)), np.int16)
    for i in range(m):
        equal += a[:, i, None] == b[None, :, i]
    floor = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / m)
    # the estimate is close to the share of equal registers; only pairs near it are estimated in full
    x, y = np.nonzero(equal >= (floor - 0.06) * m)
    adjacent = np.zeros(equal.shape, bool)
    n_a, n_b = left.n.to_numpy(), right.n.to_numpy()
    for at in range(0, len(x), 100_000):
        i, j = x[at : at + 100_000], y[at : at + 100_000]
        adjacent[i, j] = likely(a[i], b[j], n_a[i], n_b[j], threshold)
    return _edges(*_spanning(adjacent, left.rep.to_numpy(), right.rep.to_numpy()))


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products over parts of the vocabulary."""
    lengths = [len(s) for s in (*left, *right)]
    every = np.concatenate([*left, *right])
    vocabulary, code, seen = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    column, owner = number[code[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(shared.sum())
    for at in range(0, total, width):
        a, b = np.searchsorted(column, (at, at + width))
        dense = np.zeros((len(lengths), min(width, total - at)), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out).astype(np.int64)


def _linked_block(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    a, b = [np.frombuffer(s, "<u8") for s in left["set"]], [np.frombuffer(s, "<u8") for s in right["set"]]
    inter = _common_counts(a, b)
    sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None]
    return _edges(*_spanning(den * inter >= num * (sizes - inter), left.rep.to_numpy(), right.rep.to_numpy()))


def features(docs: DataFrame, id_col: str, text_col: str, k: int, registers: int = REGISTERS) -> DataFrame:
    """id, n, h1, h2, regs: size, 128-bit identity and registers of each row's shingle set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, salts = WordHashes(), _salts(registers)
        for pdf in batches:
            sets = [shingle_set(hashes.of(lower_words_of(t if isinstance(t, str) else None)), k) for t in pdf[text_col]]
            yield pd.DataFrame({
                "id": pdf["id"],
                "n": [len(s) for s in sets],
                "h1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64),
                "h2": np.array([(s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64),
                "regs": [sketch(s, salts).tobytes() if len(s) else None for s in sets],
            })

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).transform(map_frames, run, "id bigint, n bigint, h1 bigint, h2 bigint, regs binary")


def shingle_sets(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """rep, set (sorted hashes) of rows (rep, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf.rep, "set": [shingle_set(hashes.of(lower_words_of(t)), k).tobytes() for t in pdf[text_col]]})

    return docs.transform(map_frames, run, "rep bigint, set binary")


def _judge_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """src, dst, likely of rows with the registers of both."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[["src", "dst"]].assign(likely=likely(_registers(pdf.regs_a), _registers(pdf.regs_b), pdf.n_a.to_numpy(), pdf.n_b.to_numpy(), threshold))

    return pairs.transform(map_frames, run, "src bigint, dst bigint, likely boolean")


def _verify_pairs(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """src, dst, linked of rows with the sets of both."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            linked = []
            for a, b in zip(pdf.set_a, pdf.set_b, strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                inter = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * inter >= num * (len(x) + len(y) - inter))
            yield pdf[["src", "dst"]].assign(linked=linked)

    return pairs.transform(map_frames, run, "src bigint, dst bigint, linked boolean")


def _blocks(rest: DataFrame, every: DataFrame, group: str, block: int, payload: list[str], weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """Rows of ``rest`` and ``every`` (group, rep, payload) sent to the blocks (group, i, j) where they meet.

    A block's side has about ``block`` members and, where a weight is given, weighs about ``heaviest`` at most.
    """
    def parts_of(rows: DataFrame, name: str) -> DataFrame:
        number = F.ceil(F.count("*") / block)
        return rows.groupBy(group).agg((number if weight is None else F.greatest(number, F.ceil(F.sum(weight) / heaviest))).cast("int").alias(name))

    parts = parts_of(rest, "left_parts").join(parts_of(every, "right_parts"), group)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.join(parts, group).select(group, own("left_parts").alias("i"), upto("right_parts").alias("j"), F.lit(True).alias("is_left"), "rep", *payload)
    right = every.join(parts, group).select(group, upto("left_parts").alias("i"), own("right_parts").alias("j"), F.lit(False).alias("is_left"), "rep", *payload)
    return left.unionByName(right)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id, kept: components of links with den * |A & B| >= num * |A | B|."""
    short_batches(docs.sparkSession)
    threshold = num / den
    rows, bands = bands_for(threshold)
    feat = materialize(features(docs, id_col, text_col, k), "features")
    classes = materialize(feat.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.any_value("regs").alias("regs")), "classes")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * (2 * rows) + 1, F.lit(2 * rows)))))
    keyed = classes.select("rep", band.alias("key"))
    members = materialize(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "members")
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    pivots = members.join(degree, "rep").groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("pivot"))
    # ids that are used again are written: a plan that holds a step several times has as many exchanges, each with a thread and memory of the driver
    star = materialize(members.join(pivots, "key").select("key", "rep", "pivot"), "star")

    of = lambda side: classes.select(F.col("rep").alias("src" if side == "a" else "dst"), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}"))
    pairs = star.where("rep <> pivot").select(F.col("rep").alias("src"), F.col("pivot").alias("dst")).distinct()
    judged = materialize(_judge_pairs(pairs.join(of("a"), "src").join(of("b"), "dst"), threshold), "judged")
    rest = materialize(star.join(judged.where("not likely").select(F.col("src").alias("rep"), F.col("dst").alias("pivot")), ["rep", "pivot"]).select("key", "rep"), "rest")
    every = materialize(star.join(rest.select("key").distinct(), "key", "left_semi").select("key", "rep"), "every")

    def compare(_: tuple, group: pd.DataFrame) -> pd.DataFrame | None:
        left, right = group[group.is_left], group[~group.is_left]
        return _likely_block(left, right, threshold) if len(left) and len(right) else None

    met = _blocks(rest, every, "key", SKETCH_BLOCK, []).join(classes.select("rep", "n", "regs"), "rep")
    found = per_sorted_group(met, ["key", "i", "j"], compare, "src bigint, dst bigint")
    clusters = connected_components(judged.where("likely").select("src", "dst").unionByName(found))
    links = confirmed_links(docs, clusters, judged.where("likely"), id_col, text_col, k, num, den)

    labels = connected_components(links).withColumnRenamed("node", "rep")
    named = feat.select("id", "n", "h1", "h2").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left").join(labels, "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def confirmed_links(docs: DataFrame, clusters: DataFrame, seen: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """src, dst: links of full sets within clusters (node, component), enough of them to connect what is linked."""
    nodes = materialize(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "nodes")
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), text_col).where(F.col(text_col).isNotNull()).join(nodes, "rep", "left_semi")
    sets = materialize(shingle_sets(texts, text_col, k), "sets")
    # sizes are known beside the sets: what counts them doesn't move the sets themselves
    nodes = materialize(nodes.join(sets.groupBy("rep").agg(F.sum(F.length("set")).alias("bytes")), "rep"), "sized")
    size = nodes.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    size = size.select("cluster", ((F.col("size") <= SET_BLOCK) & (F.col("bytes") <= SET_BYTES)).alias("small"))
    nodes = materialize(nodes.join(size, "cluster"), "sizes")

    def within(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _linked_block(group, group, num, den)

    small = per_sorted_group(nodes.where("small").select("cluster", "rep").join(sets, "rep"), ["cluster"], within, "src bigint, dst bigint")

    large = nodes.where("not small").select("cluster", "rep", "bytes")
    degree = seen.groupBy(F.col("dst").alias("rep")).agg(F.count("*").alias("degree"))
    centre = large.join(degree, "rep", "left").groupBy("cluster").agg(F.max_by("rep", F.struct(F.coalesce("degree", F.lit(0)), -F.col("rep"))).alias("dst"))
    spokes = large.join(centre, "cluster").where("rep <> dst").select(F.col("rep").alias("src"), "dst", "cluster")
    with_sets = spokes.join(sets.select(F.col("rep").alias("src"), F.col("set").alias("set_a")), "src").join(sets.select(F.col("rep").alias("dst"), F.col("set").alias("set_b")), "dst")
    tried = materialize(_verify_pairs(with_sets, num, den), "tried")
    rest = materialize(large.join(tried.where("not linked").select(F.col("src").alias("rep")).distinct(), "rep", "left_semi"), "rest")
    every = materialize(large.join(rest.select("cluster").distinct(), "cluster", "left_semi"), "every")

    def across(_: tuple, group: pd.DataFrame) -> pd.DataFrame | None:
        left, right = group[group.is_left], group[~group.is_left]
        return _linked_block(left, right, num, den) if len(left) and len(right) else None

    met = _blocks(rest, every, "cluster", SET_BLOCK, [], F.col("bytes"), SET_BYTES).join(sets, "rep")
    others = per_sorted_group(met, ["cluster", "i", "j"], across, "src bigint, dst bigint")
    return small.unionByName(tried.where("linked").select("src", "dst")).unionByName(others)


def op3_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, num=85, den=100)


#: The same in DuckDB's SQL, by comparing all pairs that share a shingle.
OP3_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 1, 2) END), lambda i: array_to_string(ws[i:i + 2], ' ')))) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)"""

"""URL filters: rules first, then a ratio of two character language models.

Rules of hosts and path prefixes decide what they fit. For all other URLs a
smoothed variable-order Markov model of accepted URLs is set against one of
rejected URLs: URLs that the rules decide are the examples. Each model predicts a
character from up to ``ORDER`` characters before it; orders are interpolated by
Witten and Bell's rule, and a context that was never seen leaves the shorter one's
prediction as it is. The score is the difference of the log-likelihoods for each
character, so that length doesn't matter; its threshold is calibrated on a fifth
of the examples, which the models don't see, for the best balanced accuracy.

Counts are over all examples and exact: Spark adds them up by context (a 64-bit hash
of its symbols) and symbol, into a written table. Up to ``BROADCAST_PAIRS`` pairs of
context and symbol are collected and sent to all tasks. A larger table stays where it
is: distinct URLs are dealt to parts of a bounded size, each part names the contexts
that its URLs have, the table's rows of these are joined to it, and the part is scored
with them as with the whole table, so scores are equal either way. Nothing is
collected then but the calibration's bins.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; a URL without text gets ``allow``; without examples of both kinds
everything that no rule fits gets ``allow``; equal URLs get equal verdicts; an empty
table gives no rows; ``judge_urls`` carries other columns along, except those it adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_frames, materialize, read, short_batches

ORDER = 5
ALPHABET = "\x00abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#%~:+@,"
#: Byte to symbol: letters without case; what isn't in the alphabet shares the last number.
_SYMBOL = np.full(256, len(ALPHABET), np.int64)
for _i, _c in enumerate(ALPHABET):
    _SYMBOL[ord(_c)] = _i
    _SYMBOL[ord(_c.upper())] = _i
SYMBOLS = len(ALPHABET) + 1
#: Pairs of context and symbol that are sent to all tasks (about 40 bytes each), and bytes of URLs of a part beyond.
BROADCAST_PAIRS, PART_BYTES = 1_000_000, 1 << 18
#: Bins of the calibration, and the score at its ends.
_BINS, _SPAN = 400, 4.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], what: str = "name") -> Column:
    """Name (or verdict) of the longest rule that fits, else null."""
    out: Column = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def _symbols(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all URLs after their scheme, an end symbol after each, and the number of each one's URL."""
    data = [u.partition("://")[2].encode("utf-8", "surrogatepass") or u.encode("utf-8", "surrogatepass") for u in urls]
    lengths = np.array([len(d) + 1 for d in data])
    return _SYMBOL[np.frombuffer(b"\x00".join(data) + b"\x00", np.uint8)], np.repeat(np.arange(len(urls)), lengths)


def _contexts(symbols: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For each order, a 64-bit hash of each position's context; contexts don't reach into the URL before."""
    place = np.arange(len(symbols)) - np.searchsorted(owner, owner)
    code = np.zeros(len(symbols), np.uint64)
    out = []
    for order in range(ORDER + 1):
        if order:
            before = np.full(len(symbols), SYMBOLS, np.uint64)
            before[order:] = symbols[:-order]
            before[place < order] = SYMBOLS  # the start
            code = code * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(1)
        mixed = (code + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
        out.append((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD))
    return out


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number is in the sorted known ones, or their length."""
    at = np.searchsorted(known, wanted)
    return np.where(known[np.minimum(at, len(known) - 1)] == wanted, at, len(known))


class Counts:
    """How often each symbol follows each context in rejected (0) and accepted (1) URLs."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
        """Distinct pairs of contexts (uint64) and symbols, with their counts (2, pairs)."""
        self.contexts, owner = np.unique(contexts, return_inverse=True)
        cells = owner * SYMBOLS + symbols
        order = np.argsort(cells)
        self.cells = cells[order]
        totals = np.array([np.bincount(owner, x, len(self.contexts) + 1) for x in counts])
        # whole numbers as small as they fit; sums of two of them fit too
        small = np.uint32 if 2 * totals.max(initial=0) < 1 << 32 else np.uint64
        self.counts = np.concatenate([counts[:, order], np.zeros((2, 1))], axis=1).astype(small)  # the last: never seen
        self.totals, self.kinds = totals.astype(small), np.array([np.bincount(owner, x, len(self.contexts) + 1) for x in counts > 0]).astype(np.uint8)


class UrlModel:
    """Counts and the threshold; without counts everything is allowed.

    The counts are here, as ``tables``, or too many to be, in the DataFrame ``pairs``.
    """

    def __init__(self, tables: Counts | None, threshold: float = 0.0, pairs: DataFrame | None = None):
        self.tables, self.threshold, self.pairs = tables, threshold, pairs
        #: The broadcast of the model, once it is fitted.
        self.shared = None

    def scores(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood of acceptance over rejection for each character."""
        if self.tables is None or not urls:
            return np.zeros(len(urls))
        symbols, owner = _symbols(urls)
        t = self.tables
        places = [_places(t.contexts, c) for c in _contexts(symbols, owner)]
        cells = [np.where(rows < len(t.contexts), _places(t.cells, rows * SYMBOLS + symbols), len(t.cells)) for rows in places]
        logs = []
        for kind in (0, 1):
            p, known = np.full(len(symbols), 1 / SYMBOLS), np.ones(len(symbols), bool)
            for rows, cell in zip(places, cells, strict=True):
                total, kinds = t.totals[kind, rows], t.kinds[kind, rows]
                known &= total > 0
                p = np.where(known, (t.counts[kind, cell] + kinds * p) / np.maximum(total + kinds, 1), p)
            logs.append(np.log(p))
        return np.bincount(owner, logs[1] - logs[0], len(urls)) / np.bincount(owner, minlength=len(urls))


def _calibration(url: Column) -> Column:
    return F.crc32(url.cast("binary")) % 5 == 0


def fit_urls(examples: DataFrame) -> UrlModel:
    """Fit on rows (url, accepted boolean)."""
    examples = examples.where("url is not null and accepted is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind in (0, 1):
                urls = pdf.url[pdf.accepted == bool(kind)].tolist()
                if not urls:
                    continue
                symbols, owner = _symbols(urls)
                for codes in _contexts(symbols, owner):
                    known, at = np.unique(codes, return_inverse=True)
                    cells, n = np.unique(at * SYMBOLS + symbols, return_counts=True)
                    yield pd.DataFrame({"context": known[cells // SYMBOLS].view(np.int64), "symbol": cells % SYMBOLS, "kind": kind, "n": n})

    parts = examples.where(~_calibration(F.col("url"))).select("url", "accepted").transform(map_frames, count, "context bigint, symbol int, kind int, n bigint")
    pairs = materialize(parts.groupBy("context", "symbol").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1))), "pairs")
    size, *seen_kinds = pairs.agg(F.count("*"), F.coalesce(F.max("n0"), F.lit(0)), F.coalesce(F.max("n1"), F.lit(0))).first()
    if not all(seen_kinds):
        return UrlModel(None)
    if size <= BROADCAST_PAIRS:
        model = UrlModel(_tables(pairs.toArrow()))  # of checked size
        model.shared = examples.sparkSession.sparkContext.broadcast(model)  # sent once, for the calibration and for the scores
    else:
        model = UrlModel(None, pairs=pairs)

    at = F.least(F.greatest(F.floor((F.col("score") + _SPAN) / (2 * _SPAN) * _BINS), F.lit(0)), F.lit(_BINS - 1))
    seen = np.zeros((2, _BINS))
    for r in scored_urls(examples.where(_calibration(F.col("url"))).select("url", "accepted"), model).where("score is not null").groupBy(at.cast("int").alias("bin"), "accepted").count().collect():
        seen[int(r["accepted"]), r["bin"]] = r["count"]
    if seen.sum(axis=1).all():
        below = np.cumsum(seen, axis=1) / seen.sum(axis=1, keepdims=True)
        gain = np.r_[0, below[0] - below[1]]  # rejected below the edge less accepted below it
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = float(best.mean() / _BINS * 2 * _SPAN - _SPAN)  # the middle of the best edges
    return model


def _tables(pairs: pa.Table) -> Counts:
    counts = np.array([pairs[f"n{k}"].to_numpy() for k in (0, 1)], np.float64)
    return Counts(pairs["context"].to_numpy().astype(np.int64).view(np.uint64), pairs["symbol"].to_numpy().astype(np.int64), counts)


def _scores_by_join(urls: DataFrame, pairs: DataFrame) -> DataFrame:
    """url, score of distinct URLs, each part with the counts of its own contexts."""
    many = max(1, math.ceil((urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0) / PART_BYTES))
    dealt = urls.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(many)).cast("int"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            symbols, owner = _symbols(pdf.url.tolist()) if len(pdf) else (np.empty(0, np.int64), np.empty(0, np.int64))
            parts = pdf.part.to_numpy()[owner]
            for codes in _contexts(symbols, owner):
                yield pd.DataFrame({"part": parts, "context": codes.view(np.int64)}).drop_duplicates()

    needed = dealt.transform(map_frames, contexts, "part int, context bigint").distinct()
    # a context's pairs are at most the alphabet, and it is once in a part: no key is hot
    counts = needed.join(pairs, "context").select("part", "context", "symbol", "n0", "n1")

    def score(_: tuple, urls: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(urls):
            return pd.DataFrame({"url": [], "score": []})
        found = _tables(pa.Table.from_pandas(counts, preserve_index=False)) if len(counts) else None
        names = urls.url.tolist()
        return pd.DataFrame({"url": names, "score": UrlModel(found).scores(names)})

    return dealt.groupBy("part").cogroup(counts.groupBy("part")).applyInPandas(score, "url string, score double")


def scored_urls(df: DataFrame, model: UrlModel) -> DataFrame:
    """df (url and others) with score, null without text."""
    if model.pairs is not None:
        have = F.coalesce(F.col("url") != "", F.lit(False))
        # rows without a URL to score don't meet in one task
        scores = _scores_by_join(df.where(have).select("url").distinct(), model.pairs)
        return df.where(have).join(scores, "url", "left").unionByName(df.where(~have).withColumn("score", F.lit(None).cast("double")))
    shared, bare = model.shared, model if model.shared is None else None

    def score(urls: pd.Series) -> pd.Series:
        out = np.full(len(urls), np.nan)
        at = np.flatnonzero([isinstance(u, str) and bool(u) for u in urls])
        out[at] = (bare or shared.value).scores([urls.iloc[i] for i in at])
        return pd.Series(out).where(~np.isnan(out), None)

    return df.withColumn("score", F.pandas_udf(score, "double")("url"))


def judge_urls(df: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", examples: DataFrame | None = None) -> DataFrame:
    """df with host, path, rule, score (null where a rule decides) and verdict; ``examples`` (url, accepted) add to those of the rules."""
    short_batches(df.sparkSession)
    added = ("host", "path", "rule", "score", "verdict")
    rest = [c for c in df.columns if c not in added]
    # the row's own columns travel in one, so that no name of theirs meets one of ours
    named = df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(f"`{url_col}`").alias("url"))
    named = named.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, "verdict"))
    known = named.where("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"))
    model = fit_urls(known if examples is None else known.unionByName(examples.select("url", "accepted")))

    # rows that a rule decides have no URL to score
    scored = scored_urls(named.withColumn("url", F.when(F.col("ruled").isNull(), F.col("url"))), model)
    verdict = F.coalesce("ruled", F.when(F.col("score") < model.threshold, "block").otherwise("allow"))
    return scored.select(*(F.col("row")[c].alias(c) for c in rest), "host", "path", "rule", "score", verdict.alias("verdict"))


def op9_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")

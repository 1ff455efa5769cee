import random

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm import urls as U

from .conftest import HUGE

URLS = [None, "", "no scheme", "://", "HTTP://Ex.NET/", "http://net", "http://a.net/x?y", "https://EXAMPLE.net/en/1", "https://m.example.net/en", "http://badexample.com/de/", "http://x.example.com/de/1#t", "http://org/fr/", "http://é.org/fr/a?b", "http://org/fr", "http://a.org?/fr/", "x://y://net/", "http://a.net#/", "http://a.b/" + "x" * 20000]


def plain(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_rules_and_verdicts(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(HUGE, URLS[4], "h", "r"), (None, URLS[4], "h", "r")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, ruled string, row string")
    out = U.judge_urls(df).collect()
    assert len(out) == len(rows) and {r["page_id"] for r in out} >= {HUGE, None}
    for r in out:
        host, path, rule = plain(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
        assert r["ruled"] == "h" and r["row"] == "r"
    assert U.judge_urls(df.limit(0)).count() == 0


def brute_scores(tables_of, urls):
    """The interpolated model, one character at a time."""
    counts = []
    for kind in (0, 1):
        c = {}
        for u in tables_of[kind]:
            s = u.partition("://")[2] + "\0"
            for i, ch in enumerate(s):
                for n in range(U.ORDER + 1):
                    ctx = (n, tuple(s[i - k] if i - k >= 0 else None for k in range(1, n + 1)))
                    c.setdefault(ctx, {}).setdefault(ch, 0)
                    c[ctx][ch] += 1
        counts.append(c)
    out = []
    for u in urls:
        s, total = u.partition("://")[2] + "\0", 0.0
        for i, ch in enumerate(s):
            logs = []
            for c in counts:
                p = 1 / U.SYMBOLS
                for n in range(U.ORDER + 1):
                    seen = c.get((n, tuple(s[i - k] if i - k >= 0 else None for k in range(1, n + 1))))
                    if seen:
                        p = (seen.get(ch, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
                logs.append(np.log(p))
            total += logs[1] - logs[0]
        out.append(total / len(s))
    return np.array(out)


def made(r, good):
    return "http://" + "".join(r.choice("abcde" if good else "vwxyz") for _ in range(6)) + r.choice((".com/", ".de/")) + "".join(r.choice("abcde12" if good else "wxyz-") for _ in range(r.randrange(3, 9)))


def test_model_is_the_interpolated_one(spark):
    r = random.Random(1)
    rows = [(made(r, i % 2 == 0), i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, accepted boolean")
    model = U.fit_urls(df)
    kept = [(x["url"], x["accepted"]) for x in df.where(~U._calibration(F.col("url"))).collect()]
    fresh = [made(r, i % 2 == 0) for i in range(20)]
    exact = brute_scores(([u for u, y in kept if not y], [u for u, y in kept if y]), fresh)
    assert np.abs(model.scores(fresh) - exact).max() < 1e-9


def test_held_out_urls_are_told_apart(spark):
    r = random.Random(2)
    rows = [(made(r, i % 2 == 0), i % 2 == 0) for i in range(600)]
    model = U.fit_urls(spark.createDataFrame(rows, "url string, accepted boolean"))
    fresh = [(made(r, i % 3 == 0), i % 3 == 0) for i in range(200)]
    verdicts = model.scores([u for u, _ in fresh]) >= model.threshold
    assert np.mean(verdicts == [y for _, y in fresh]) > 0.97
    one = U.fit_urls(spark.createDataFrame(rows, "url string, accepted boolean").where(F.col("accepted")))
    assert one.tables is None


def test_contexts_beyond_any_fixed_table(spark):
    r = random.Random(4)
    chars = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [("http://" + "".join(r.choice(chars) for _ in range(40)), i % 2 == 0) for i in range(4000)]
    model = U.fit_urls(spark.createDataFrame(rows, "url string, accepted boolean"))
    kept = [x["url"] for x in spark.createDataFrame(rows, "url string, accepted boolean").where(~U._calibration(F.col("url"))).collect()]
    seen = dict(rows)
    fresh = ["http://" + "".join(r.choice(chars) for _ in range(40)) for _ in range(20)] + kept[:10]
    exact = brute_scores(([u for u in kept if not seen[u]], [u for u in kept if seen[u]]), fresh)
    assert np.abs(model.scores(fresh) - exact).max() < 1e-9


def test_scores_by_join_are_those_of_the_broadcast(spark, monkeypatch):
    r = random.Random(6)
    rows = [(made(r, i % 2 == 0), i % 2 == 0) for i in range(300)]
    examples = spark.createDataFrame(rows, "url string, accepted boolean")
    pages = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, made(r, i % 3 == 0)) for i in range(60)] + [(200 + i, "http://same.example/of/many") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id bigint, url string")

    def judged():
        return sorted(map(tuple, U.judge_urls(df, examples=examples).select("page_id", "rule", "score", "verdict").collect()))

    small = U.fit_urls(examples)
    want = judged()
    monkeypatch.setattr(U, "BROADCAST_PAIRS", 10)
    monkeypatch.setattr(U, "PART_BYTES", 700)
    large = U.fit_urls(examples)
    assert small.pairs is None and small.tables is not None and large.tables is None and large.shared is None and large.threshold == small.threshold
    assert judged() == want and len(want) == len(pages)
    assert U.judge_urls(df.limit(0), examples=examples).count() == 0
    assert U._scores_by_join(df.where("url <> ''").select("url").distinct(), large.pairs).rdd.getNumPartitions() >= 1

import math
import random

import numpy as np
import pytest

from tamarack.llm import neardup as N
from tamarack.llm.common import connected_components

from .conftest import HUGE


def shingles(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    """Components by comparing all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in sets}


def drifting(n, seed, words=60):
    """Copies that each change the one before a little: the first and the last are far apart."""
    r = random.Random(seed)
    text = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(text)
        text[r.randrange(words)] = f"v{r.randrange(5000)}"
        out.append(" ".join(text))
    return out


def test_components_are_those_of_all_pairs(docs, monkeypatch):
    monkeypatch.setattr(N, "SET_BLOCK", 8)
    monkeypatch.setattr(N, "SKETCH_BLOCK", 16)
    texts = [None, "", "   ", "one", "ONE", "one two", "a b c", "A b\tC", *drifting(40, 1), *drifting(12, 2, 200)]
    base = drifting(1, 3, 80)[0].split()
    for i in range(30):  # copies of one text, each changed elsewhere
        copy = list(base)
        for j in range(i % 5):
            copy[(i * 7 + j * 13) % 80] = f"c{i}{j}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(HUGE, texts[-1]), (None, texts[-1]), (8, "another text under an id that exists"), (9, texts[9])]
    out = N.near_duplicates(docs(rows), k=3, num=85, den=100).collect()
    want = brute(rows, 3, 85, 100)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {i: len(shingles(t, 3)) for i, t in enumerate(texts)}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out if r["doc_id"] in sizes and r["doc_id"] != 8)


def test_empty_table(docs):
    assert N.near_duplicates(docs([])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    salts = N._salts(512)
    a, b = rng.integers(0, 1 << 63, 3000, np.uint64), rng.integers(0, 1 << 63, 1000, np.uint64)
    both = np.concatenate([a[:2000], b])
    x, y = N.sketch(a, salts), N.sketch(both, salts)
    assert (N.merge(x, y) == N.sketch(np.union1d(a, both), salts)).all()
    j = 2000 / 4000
    up, down = int((x > y).sum()), int((x < y).sum())
    slope = lambda t: float(N.likelihood_slope(up, down, 512 - up - down, 3000, 3000, t))
    sd = math.sqrt(j * (1 - j) / 512)
    assert slope(j - 4 * sd) > 0 > slope(j + 4 * sd)


def test_bands_lose_little():
    for t in (0.8, 0.85, 0.9):
        rows, bands = N.bands_for(t)
        assert (1 - t**rows) ** bands <= 2e-5 and rows * bands <= N.REGISTERS


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500)], "src bigint, dst bigint")
    out = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert out == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def test_components_that_need_more_rounds_are_not_returned(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "src bigint, dst bigint")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)


def test_plans_stay_short(docs, spark):
    """Joins and exchanges of a plan each take threads and memory of the driver, so no plan holds a step several times."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, texts = store.executionsCount(), drifting(40, 5)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # plans as they are made, whatever the tables hold
    try:
        out = N.near_duplicates(docs(list(enumerate(texts)))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r["doc_id"]: r["component_id"] for r in out} == brute(list(enumerate(texts)), 5, 80, 100)
    found = []
    executions = store.executionsList(int(before), 1000)
    for i in range(executions.size()):
        nodes = store.planGraph(executions.apply(i).executionId()).allNodes()
        found.append(sum(nodes.apply(j).name().endswith("Join") for j in range(nodes.size())))
    assert len(found) > 10 and 0 < max(found) <= 10, found  # 24 where ids weren't written

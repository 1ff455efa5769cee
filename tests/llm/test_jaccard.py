import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import jaccard as J

from .conftest import HUGE
from .test_neardup import brute, drifting, shingles


def texts():
    r = random.Random(9)
    line = " ".join(f"licence{i}" for i in range(40))  # many documents hold it
    out = [None, "", "   ", "one", "ONE", "one two", "a b c d", "A b\tc D", "a b c d e", "a b c d e f", *drifting(30, 1), *drifting(12, 2, 200)]
    out += [line + " " + " ".join(f"own{i}x{j}" for j in range(r.choice([3, 10, 60]))) for i in range(40)]
    out += [" ".join(r.choice(["spam", "ham"]) for _ in range(n)) for n in range(1, 25)]
    base = drifting(1, 3, 120)[0].split()
    for i in range(40):  # copies of one text, each changed elsewhere
        copy = list(base)
        for j in range(i % 5):
            copy[(i * 7 + j * 29) % 120] = f"c{i}{j}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("k", "num", "den", "combined", "rare"), [(5, 80, 100, J.COMBINED, J.RARE), (5, 80, 100, 4, 1), (3, 1, 2, 6, 0), (1, 9, 10, 24, 0)])
def test_components_are_those_of_all_pairs(docs, monkeypatch, k, num, den, combined, rare):
    monkeypatch.setattr(J.keys_of, "__defaults__", (rare, combined))
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "BLOCK_ELEMENTS", 300)
    rows = list(enumerate(texts())) + [(HUGE, texts()[-1]), (None, texts()[-1]), (8, "another text under an id that exists"), (9, texts()[9]), (2, "one two")]
    out = J.similarity_join(docs(rows), k=k, num=num, den=den).collect()
    want = brute(rows, k, num, den)
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["component_id"] for r in out}
    assert got.pop(None) is None and got == want
    sizes = {i: len(shingles(t, k)) for i, t in enumerate(texts())}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out if r["doc_id"] in sizes and r["doc_id"] not in (2, 8))


def test_empty_table(docs):
    assert J.similarity_join(docs([])).count() == 0


def test_linked_sets_share_what_the_prefixes_must():
    rng = np.random.default_rng(4)
    for num, den in ((80, 100), (1, 2), (9, 10)):
        seen = 0
        for _ in range(4000):
            n, m = rng.integers(1, 60, 2)
            m = max(1, n - int(rng.integers(0, 4))) if rng.random() < 0.9 else m
            common = min(n, m) - int(rng.integers(0, min(n, m, 5) + 1))
            if den * common < num * (n + m - common):
                continue
            seen += 1
            every = rng.permutation(200)
            a, b = np.sort(every[:n]), np.sort(np.r_[every[:common], every[n : n + m - common]])
            prefix = lambda s: set(s[: len(s) - J.needed(len(s), num, den) + J.shared_at_least(len(s), num, den)])
            assert len(prefix(a) & prefix(b)) >= J.shared_at_least(min(n, m), num, den) >= J.shared_at_least(J.needed(max(n, m), num, den), num, den)
        assert seen > 50


def test_frequent_elements_are_keys_in_twos(spark):
    rows = [(c, e, False) for c in range(10) for e in (1, 2, 3)] + [(c, 100 + c % 5, False) for c in range(10)] + [(10, 1, False), (11, 2, False)]
    keys = J.keys_of(spark.createDataFrame(rows, "class bigint, element bigint, one boolean"), rare=2, combined=3)
    sizes = sorted(r["count"] for r in keys.groupBy("key").count().collect())
    assert sizes == [2] * 5 + [10] * 3  # five rare elements alone, three pairs; who has one frequent element alone has no key
    long = rows + [(12, e, False) for e in (1, 2, 3, 4)] + [(13 + i, 4, False) for i in range(4)]
    alone = J.keys_of(spark.createDataFrame(long, "class bigint, element bigint, one boolean"), rare=2, combined=3).groupBy("key").count()
    assert alone.agg(F.max("count")).first()[0] == 12  # a class of many frequent elements leads them alone, in all classes

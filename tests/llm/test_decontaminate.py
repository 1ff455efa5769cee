import random

import numpy as np

from tamarack.llm import decontaminate as D

from .conftest import HUGE


def text(r, n):
    return " ".join(r.choice(("the", "of", "and")) if r.random() < 0.35 else f"{r.choice('abcdefghij')}{r.choice('aeiou')}{r.choice('rstlmnk')}{r.randrange(400)}" for _ in range(n))


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(100):
        a, b = [r.randrange(6) for _ in range(r.randrange(1, 90))], [r.randrange(6) for _ in range(r.randrange(0, 90))]
        assert D.common_subsequence(D._masks(np.array(a)), len(a), b) == slow(a, b)


def test_answers():
    assert D.answer_of("One two three. Four five six.\nYes.") == "Four five six."
    assert D.answer_of("Only") == "Only" and D.answer_of(" ") == ""


def test_planted_items_are_found_and_clean_documents_left(spark, docs):
    r = random.Random(2)
    items = [text(r, n) + ". " + text(r, 8) + "." for n in (10, 14, 20, 30, 45, 60, 90, 25)]
    rows, want = [], set()
    for i in range(120):
        words = text(r, r.choice((30, 80, 300, 1500))).split()
        if i % 3 == 0:
            k = i // 3 % len(items)
            item = items[k].split()
            if i % 2:  # a paraphrase: words changed before the answer, which stays
                for at in range(0, len(item) - 9, 4):
                    item[at] = f"changed{at}"
            at = r.randrange(len(words) + 1)
            words[at:at] = item
            want.add((i, k))
        rows.append((i, " ".join(words)))
    rows += [(500, items[0]), (501, None), (502, ""), (HUGE, items[1]), (None, items[2]), (503, items[3].upper()), (503, items[3].upper())]
    want |= {(500, 0), (HUGE, 1), (None, 2), (503, 3)}
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(98, None), (99, "")], "item_id bigint, text string")
    found = D.matches(docs(rows), bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(want & got) >= 0.9 * len(want)
    assert not got - want, [(r, rows[r['doc_id']][1][:80] if r['doc_id'] and r['doc_id'] < 120 else '', items[r['item_id']]) for r in found if (r['doc_id'], r['item_id']) not in want]
    kept = [r["doc_id"] for r in D.decontaminate(docs(rows), bench).collect()]
    assert None in kept and not {d for d, _ in got if d is not None} & set(kept)
    assert {i for i, _ in rows if i is not None} - {d for d, _ in got} == {i for i in kept if i is not None}


def test_latent_candidates_against_brute_force(spark, docs):
    r = random.Random(3)
    items = [text(r, 40) for _ in range(12)]
    rows = [(i, text(r, 100) + " " + items[i % 12] + " " + text(r, 100)) for i in range(96)]
    df = D.coded(docs(rows), "doc_id").cache()
    freq, passages = D.passage_frequencies(df)
    idf = (np.log((1 + passages) / (1 + freq)) + 1).astype(np.float32)
    to_latent = D.latent_space(df, idf) * idf[:, None]
    block = D.Items(list(enumerate(items)), to_latent, idf)
    grid, begin = D._laid_out([r["features"] for r in df.orderBy("doc_id").collect()])
    where, item, _ = block.candidates(grid, begin, D._block_sums(grid, D._extended(to_latent)))
    doc = np.searchsorted(begin, where, "right") - 1
    got = set(zip(doc.tolist(), item.tolist()))
    assert np.mean([(i, i % 12) in got for i in range(96)]) >= 0.9


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    assert D.matches(docs([]), bench).count() == 0
    assert D.matches(docs([(1, "a b c d")]), bench.limit(0)).count() == 0


def planted(spark, docs, seed, lengths, keep, copies=6):
    """Share of planted items that is found, by length: copies, or paraphrases that keep ``keep`` of the words and the answer."""
    r = random.Random(seed)
    items = [text(r, n - 8) + ". " + text(r, 8) + "." if n > 16 else text(r, n) for n in lengths]
    rows, want = [], []
    for k, n in enumerate(lengths):
        for _ in range(copies):
            item, words = items[k].split(), text(r, r.randrange(60, 400)).split()
            if keep < 1:
                for at in r.sample(range(n - 8), int(n * (1 - keep))):
                    item[at] = f"changed{r.randrange(10**6)}"
            at = r.randrange(len(words) + 1)
            words[at:at] = item
            want.append((len(rows), k))
            rows.append((len(rows), " ".join(words)))
    rows += [(10_000 + i, text(r, 300)) for i in range(100)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.matches(docs(rows), bench).collect()}
    assert not got - set(want)
    return {n: np.mean([w in got for w in want if w[1] == k]) for k, n in enumerate(lengths)}


def test_items_longer_than_a_passage(spark, docs):
    lengths = (200, 250, 300, 500, 1000)
    assert set(planted(spark, docs, 5, lengths, 1).values()) == {1.0}
    assert min(planted(spark, docs, 6, (100, *lengths), 0.55).values()) >= 0.8


def test_items_of_a_few_words(spark, docs):
    lengths = (3, 4, 5, 6, 8, 12, 16)
    assert set(planted(spark, docs, 7, lengths, 1).values()) == {1.0}
    assert np.mean(list(planted(spark, docs, 8, (24, 32, 48), 0.6, 20).values())) >= 0.9


def test_tables_without_candidates(spark, docs):
    r = random.Random(12)
    bench = spark.createDataFrame([(0, text(r, 30)), (1, "zork quux")], "item_id bigint, text string")
    clean = [(i, " ".join(f"q{i}x{k}" for k in range(60))) for i in range(40)]
    blank = [(100 + i, t) for i, t in enumerate([None, "", "  \n ", None])]
    for rows in (clean, blank, clean + blank):
        df = docs(rows).repartition(3)
        assert D.matches(df, bench).count() == 0 and D.decontaminate(df, bench).count() == len(rows)
    hit = docs([*clean, (7000, "a b zork quux c")]).repartition(3)
    assert [(x["doc_id"], x["item_id"]) for x in D.matches(hit, bench).collect()] == [(7000, 1)]


def test_equal_texts_match_alike(spark, docs):
    r = random.Random(13)
    item = text(r, 40)
    body = text(r, 50) + " " + item + " " + text(r, 50)
    rows = [(i, body) for i in range(9)] + [(50 + i, text(r, 90)) for i in range(9)]
    found = D.matches(docs(rows).repartition(4), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert {x["doc_id"] for x in found} == set(range(9)) and len({tuple(x)[1:] for x in found}) == 1


def test_regions_are_bounded_and_cover():
    words = np.arange(5000, dtype=np.uint64)
    for start, stop, length in ((0, 5000, 20), (17, 4000, 100), (0, 60, 40), (10, 5001, 1000), (4990, 6000, 30)):
        found = list(D.regions(words, start, stop, length))
        assert max(map(len, found)) <= 3 * length + 48
        for at in range(start, min(stop, 5000) - 1, 7):  # a stretched item is whole in one of them
            end = min(at + 2 * length + 48, stop, 5000)
            assert any(f and f[0] <= at and f[-1] >= end - 1 for f in found), (start, stop, length, at)


def test_matches_against_a_comparison_of_everything(spark, docs):
    """All items with all places of all documents, by the longest common subsequence alone."""
    r = random.Random(14)
    items = [text(r, n - 8) + ". " + text(r, 8) + "." for n in (14, 20, 30, 45, 60, 90)]
    rows = []
    for i in range(150):
        words, item = text(r, r.choice((40, 150, 500))).split(), items[i % 6].split()
        for at in r.sample(range(len(item) - 8), int((len(item) - 8) * r.choice((0, 0.1, 0.3, 0.4, 0.8)))):
            item[at] = f"new{r.randrange(10**6)}"
        at = r.randrange(len(words) + 1)
        words[at:at] = item if i % 5 else []
        rows.append((i, " ".join(words)))
    cores = D.Cores()
    want = set()
    for k, t in enumerate(items):
        h, a = cores.of_text(t), cores.of_text(D.answer_of(t))
        masks, answer, n = D._masks(h), D._masks(a), len(h)
        for i, body in rows:
            w = cores.of_text(body).tolist()
            for at in range(0, max(1, len(w) - 2 * n), max(1, n // 4)):
                part = w[at : at + 2 * n]
                common = D.common_subsequence(masks, n, part)
                if common >= D.COPY * n or (common >= D.PARAPHRASE * n and D.common_subsequence(answer, len(a), part) >= D.ANSWER * len(a)):
                    want.add((i, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.matches(docs(rows), bench).collect()}
    assert len(want) > 60 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_sums_by_feature_of_few_and_of_many_places():
    rng = np.random.default_rng(3)
    for high, n in ((40, 200), (8000, 200), (9, 1)):
        rows = np.minimum(rng.integers(0, high, (n, 48)), rng.integers(0, high, (n, 48))).astype(np.uint16)
        y = rng.standard_normal((n, 5)).astype(np.float32)
        want = np.zeros((8001, 5))
        np.add.at(want, rows, y[:, None].astype(np.float64))
        found, sums = D._sums_by_feature(rows, y)
        assert sorted(found) == sorted(set(rows.ravel().tolist()))
        got = np.zeros((8001, 5))
        got[found] = sums
        assert np.allclose(got, want, atol=1e-3)


def test_features_are_those_of_the_words_whatever_the_white_space(spark):
    texts = ["", None, " a  b ", "\x00a\x1cb\tc\x0bd\x0ce\rf\ng", "é x x X", "a b c " * 50, "   "]
    cores = D.Cores()
    want = [(i, t, D._feature(cores.of_text(t)).astype("<u2").tobytes()) for i, t in enumerate(texts)]
    coded = D.coded(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), "doc_id")
    assert sorted((r["doc_id"], r["text"], bytes(r["features"])) for r in coded.collect()) == want

import random

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm.latent import inverse_frequencies, right_singular_vectors, times, transposed_times, weighted
from tamarack.llm.quality import NEIGHBOURS, SHARPNESS, counter, fit_quality, op5_latent_neighbour_quality, score_quality, shape
from tamarack.llm.toxicity import HIDDEN, Network, _sigmoid, coded, fit_toxicity, held_out, labelled_sample, op4_recurrent_toxicity, score_toxicity, windows_of

from .conftest import HUGE

BAD = ("vile", "rotten", "nasty")


def prose(r, n, bad=0):
    w = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('rstlmn')}{r.choice('aeiou')}" for _ in range(n)]
    for _ in range(bad):
        w[r.randrange(n)] = r.choice(BAD) + r.choice(("", ".", "!"))
    return " ".join(w)


def sample(seed, n):
    r = random.Random(seed)
    return [(prose(r, r.randrange(5, 200), bad=2 * y), y) for y in (r.randrange(2) for _ in range(n))]


def plain_forward(net, words, index):
    """Logits one window, direction and word at a time, from the formulas."""
    x = net.inputs(coded(words))
    sig = lambda v: 1 / (1 + np.exp(-v))
    out = []
    for row in index:
        states = [[None] * len(row) for _ in (0, 1)]
        for d, order in ((0, range(len(row))), (1, range(len(row) - 1, -1, -1))):
            h = np.zeros(HIDDEN)
            for s in order:
                g = x[row[s] - 1] @ net.p["wx"][d] + net.p["b"][d][0] if row[s] else np.zeros(3 * HIDDEN)
                hu = h @ net.p["u"][d]
                z, r = sig(g[:HIDDEN] + hu[:HIDDEN]), sig(g[HIDDEN : 2 * HIDDEN] + hu[HIDDEN : 2 * HIDDEN])
                c = np.tanh(g[2 * HIDDEN :] + r * hu[2 * HIDDEN :])
                h = z * h + (1 - z) * c
                states[d][s] = h
        full = np.array([np.concatenate([states[0][s], states[1][s]]) for s in range(len(row))])
        e = np.exp(np.tanh(full @ net.p["wa"] + net.p["ba"]) @ net.p["va"]) * (np.array(row) > 0)
        out.append((e / e.sum()) @ full @ net.p["wo"] + net.p["bo"][0])
    return np.array(out)


def test_forward_pass_is_the_plain_one():
    net, rng = Network(3), np.random.default_rng(4)
    words = [f"word{i}".encode() for i in range(9)]
    net.p["b"] = rng.standard_normal(net.p["b"].shape).astype(np.float32)
    index = rng.integers(0, 10, (6, 7))
    index[:, 2] = 1
    assert np.allclose(net.forward(net.gates(net.inputs(coded(words))), index), plain_forward(net, words, index), atol=1e-4)
    assert np.allclose(net.vocabulary_gates(words, part=4), net.gates(net.inputs(coded(words))))


def test_scores_are_the_highest_window_of_the_plain_pass():
    model = fit_toxicity(sample(1, 60), epochs=1)
    texts = [prose(random.Random(i), n) for i, n in enumerate((3, 40, 90))]
    for text, score in zip(texts, next(model.scores([texts])), strict=True):
        words = text.split()
        rows = [list(range(s + 1, min(s + 32, len(words)) + 1)) + [0] * (32 - len(words)) for s in windows_of(len(words))]
        top = plain_forward(model.net, [w.encode() for w in words], rows).max()
        assert abs(score - _sigmoid(model.slope * top + model.shift)) < 1e-3


def test_gradients_are_those_of_the_loss():
    net, rng = Network(1), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [f"w{i}".encode() for i in range(6)]
    index, y = rng.integers(0, 7, (4, 5)), np.array([0, 1, 1, 0.0])
    index[:, 0] = 1

    def loss():
        p = _sigmoid(net.forward(net.gates(net.inputs(coded(words))), index))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    grads = net.gradients(coded(words), index, lambda logit: _sigmoid(logit) - y)
    for name in net.p:
        flat = net.p[name].ravel()
        used = np.flatnonzero(np.abs(grads[name].ravel()) > 1e-9)
        for at in {int(used[0]), int(used[len(used) // 2]), int(used[-1])}:
            was = flat[at]
            flat[at] = was + 1e-3
            up = loss()
            flat[at] = was - 1e-3
            down = loss()
            flat[at] = was
            assert abs((up - down) / 2e-3 - grads[name].ravel()[at]) < 5e-3 + 0.02 * abs(grads[name].ravel()[at]), name


def test_windows_cover_everything_and_overlap():
    for n in (1, 31, 32, 33, 48, 100, 1001):
        seen = {i for s in windows_of(n) for i in range(s, min(n, s + 32))}
        assert seen == set(range(n))


def test_toxicity_is_learnt_and_found_anywhere(docs):
    model = fit_toxicity(sample(1, 400))
    fresh = sample(2, 200)
    scores = np.concatenate(list(model.scores([[t for t, _ in fresh]])))
    assert np.mean((scores >= 0.5) == [y for _, y in fresh]) > 0.95
    r = random.Random(3)
    long = prose(r, 5000).split()
    for at in (0, 2500, 4999):
        w = list(long)
        w[at] = "rotten"
        assert next(model.scores([[" ".join(w)]]))[0] > next(model.scores([[" ".join(long)]]))[0]
    rows = [(1, None), (2, ""), (3, " \n "), (HUGE, fresh[0][0]), (None, fresh[0][0]), (4, fresh[0][0]), (5, "x" * 100000)]
    out = [(r["doc_id"], r["score"]) for r in score_toxicity(docs(rows), model).collect()]
    by = dict(out)
    assert by[1] == by[2] == by[3] == model.share and by[HUGE] == by[4] == by[None] and all(0 <= s <= 1 for _, s in out)
    assert score_toxicity(docs([]), model).count() == 0


def test_one_label_gives_zero():
    assert list(next(fit_toxicity([("a b", 1)]).scores([["a", None]]))) == [0, 0]


def test_sample_keeps_out_and_is_bounded(spark, docs):
    df = docs([(i, f"t{i}") for i in range(100)])
    labels = spark.createDataFrame([(i, i % 3, i % 2) for i in range(100)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = labelled_sample(df, labels, "toxic", held_out(F.col("doc_id")), 20)
    assert len(rows) == 40
    import zlib

    assert all(zlib.crc32(t[1:].encode()) % 5 and int(t[1:]) % 2 == y for t, y in rows)


def test_singular_vectors_of_a_small_matrix():
    rng = np.random.default_rng(0)
    counts = [(np.sort(rng.choice(30, 6, False)), rng.integers(1, 5, 6)) for _ in range(50)] + [(np.empty(0, int), np.empty(0, int))]
    rows = weighted(counts, inverse_frequencies(np.ones(30), 50))
    dense = np.zeros((51, 30))
    for i in range(51):
        a, b = rows[2][i], rows[2][i + 1]
        dense[i, rows[0][a:b]] = rows[1][a:b]
    q = rng.standard_normal((30, 4)).astype(np.float32)
    assert np.allclose(times(rows, q, part=7), dense @ q, atol=1e-5)
    y = rng.standard_normal((51, 4)).astype(np.float32)
    assert np.allclose(transposed_times(rows, y, 30, part=7), dense.T @ y, atol=1e-5)
    v, s = right_singular_vectors(rows, 30, 5, power=8)
    assert np.allclose(s, np.linalg.svd(dense)[1][:5], rtol=1e-2)


def test_quality_votes(spark, docs):
    r = random.Random(5)
    good = [prose(r, 60) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose(r, 60).split()) for _ in range(30)] + [" ".join([prose(r, 1)] * 60) for _ in range(30)]
    texts = [t for pair in zip(good, junk) for t in pair] + ["", None, good[0], good[0]]
    df = docs(list(enumerate(texts)) + [(HUGE, good[1]), (None, good[1])])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 80)], "doc_id bigint, quality int")
    model = fit_quality(df, labels, "quality", F.lit(False))
    out = {r["doc_id"]: r["score"] for r in score_quality(df, model).collect()}
    assert all((out[i] >= 0.5) == (i % 2 == 0) for i in range(120))
    assert out[120] == out[121] == 0.5 and out[122] == out[123] == out[0] and out[HUGE] == out[None] == out[2]
    nothing = fit_quality(df, labels.limit(0), "quality", F.lit(False))
    assert {r["score"] for r in score_quality(df, nothing).collect()} == {0.5}
    assert score_quality(docs([]), model).count() == 0


def test_shapes():
    assert [shape(w) for w in ("the", "The", "THE", "12,5", "SE!!", "a$$$$$$", "Ünder.", "")] == ["a", "Aa", "A", "0,0", "A!!", "a$$$", "Aa.", ""]
    assert len(counter()(None)[0]) == 0


def test_toxic_parts_of_words_without_spaces_are_found():
    model = fit_toxicity(sample(1, 400))
    model.net.p["word"][:] = 0  # what is left is what runs of bytes say, not the hash of a whole word
    clean = prose(random.Random(5), 400).replace(" ", "_")
    for at in (70, 900, len(clean)):
        glued = clean[:at] + "_rotten_vile_nasty_" * 4 + clean[at:]
        assert next(model.scores([[glued]]))[0] > next(model.scores([[clean]]))[0], at


def test_votes_are_those_of_all_cosines(spark, docs):
    r = random.Random(8)
    texts = [prose(r, r.randrange(5, 80)) if i % 2 else prose(r, r.randrange(5, 80)).upper() + "!!" for i in range(260)]
    df = docs(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    model = fit_quality(df, labels, "quality", F.lit(False), most=120)
    # one document and one sample vector at a time, from the weights and the basis
    count = counter()
    for i in range(200, 260):
        features, n = count(texts[i])
        x = np.zeros(len(model.idf))
        x[features] = (1 + np.log(n)) * model.idf[features]
        z = (x / np.linalg.norm(x)) @ model.basis
        cosine = np.array([z @ v / np.linalg.norm(z) for v in model.vectors])
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[:NEIGHBOURS]
        weight = [max(cosine[k], 1e-3) ** SHARPNESS for k in near]
        want = sum(w * model.labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight)
        assert abs(model.scores([count(texts[i])])[0] - want) < 1e-3
    by = {x["doc_id"]: x["score"] for x in score_quality(df, model).collect()}
    assert all(abs(by[i] - model.scores([count(texts[i])])[0]) < 1e-6 for i in range(260))
    long = docs([(1, texts[0] + " " + prose(r, 60_000)), (2, None)])
    assert all(0 <= x["score"] <= 1 for x in score_quality(long, model).collect())


def test_queries_hold_out_and_predict(spark, docs, tmp_path):
    r = random.Random(9)
    rows = [(i, prose(r, 40, bad=2 * (i % 3 == 0))) for i in range(300)] + [(900, None), (901, ""), (HUGE, prose(r, 40, bad=3)), (None, "x"), (7, "again"), (7, "again")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(300)] + [(0, 0, 1), (8, 0, 1), (8, 1, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    import zlib

    for query, folds, fold, label in ((op4_recurrent_toxicity, 5, 0, lambda i: i % 3 == 0), (op5_latent_neighbour_quality, 3, 1, lambda i: i % 3 != 0)):
        out = query(spark, str(tmp_path)).collect()
        assert sorted((str(x["doc_id"]) for x in out)) == sorted(str(i) for i, _ in rows)
        assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % folds == fold) for x in out)
        assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
        if query is op4_recurrent_toxicity:
            held = [x for x in out if x["held_out"] and (x["doc_id"] or 0) < 300 and x["doc_id"] not in (None, 7)]
            assert np.mean([x["predicted"] == label(x["doc_id"]) for x in held]) > 0.9


def test_sample_is_bounded_in_bytes_and_conflicts_have_no_label(spark, docs):
    df = docs([(i, "x" * 1000) for i in range(40)] + [(50, "y" * 5000), (51, "z"), (51, "a"), (52, "both")])
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(50, 1), (51, 0), (52, 0), (52, 1)], "doc_id bigint, toxic int")
    rows = labelled_sample(df, labels, "toxic", F.lit(False), 100, most_bytes=64 * 1000)
    assert ("a", 0) in rows and not {"z", "both", "y" * 5000} & {t for t, _ in rows} and len(rows) == 41
    assert len(labelled_sample(df, labels.where("doc_id < 40"), "toxic", F.lit(False), 100, most_bytes=64 * 1000)) == 40
    assert len(labelled_sample(df.withColumn("text", F.repeat("text", 1)), labels.where("doc_id < 40"), "toxic", F.lit(False), 10, most_bytes=64 * 1000)) == 10

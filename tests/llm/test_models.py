"""Trained operators: held-out accuracy, and what is defined for odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from quarry.llm import classify, language, queries


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    judged = [(rows[d].predicted, y) for d, y in labels.items() if d in rows and held(d)]
    assert sum(p == y for p, y in judged) >= 0.93 * len(judged)
    good = [p for p, y in judged if y == 1]
    assert sum(good) >= 0.98 * len(good)
    assert {d: r.score for d, r in rows.items()} == {r.doc_id: r.score for r in queries.op5_quality(spark, sf).collect()}


def test_scores_are_sparse_dot_products():
    model = classify.train(["a b a", "Q? Q? Q?"] * 20, [1, 0] * 20, bits=16)
    for text in ("a b", "Q? Q?", "", "a a a Q?"):
        at, _ = classify.buckets(pa.array([text]), 16)
        z = model.bias + sum(float(model.weights[i]) for i in at.tolist()) / max(len(at), 1) ** 0.5
        assert abs(model.score(pa.array([text]))[0] - 1 / (1 + np.exp(-z))) < 1e-9
    assert model.score(pa.array(["a b"]))[0] > 0.5 > model.score(pa.array(["Q? Q?"]))[0]


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "w " * 10**5, 5), (2, "a b", 5), (3, "q!", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, None), (None, 1), (9, 1)], "doc_id long, quality int")
    rows = classify.score(docs, classify.fit(docs, labels)).collect()
    assert len(rows) == 5 and rows[0].score == rows[1].score
    nothing = classify.score(docs, classify.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in nothing} == {0.5}
    assert classify.score(docs.limit(0), classify.train([], [])).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_language(spark, sf).collect()
    assert len(rows) == len(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(judged) >= 0.98 * len(judged)


def exact_posteriors(emission, transitions, start):
    """One chain, step by step, in logarithms."""
    n, k = emission.shape
    add = lambda x: np.logaddexp.reduce(x, axis=0)
    alpha, beta = np.zeros((n, k)), np.zeros((n, k))
    alpha[0] = start + emission[0]
    for t in range(1, n):
        alpha[t] = add(alpha[t - 1][:, None] + transitions) + emission[t]
    for t in range(n - 2, -1, -1):
        beta[t] = add((transitions + emission[t + 1] + beta[t + 1]).T)
    both = alpha + beta
    return np.exp(both - add(both.T)[:, None])


def test_posteriors_of_whole_chains():
    rng = np.random.default_rng(5)
    for k in (1, 3, 4):
        transitions, start = rng.normal(0, 2, (k, k)), rng.normal(0, 1, k)
        count = np.array([3, 0, 1, 63, 64, 65, 0, 130, 128, 1000, 2, 7000])
        emission = rng.normal(0, 2, (count.sum(), k)).astype(np.float32)
        got, end = language.posteriors(emission, count, transitions, start), np.cumsum(count)
        for a, b in zip(end - count, end, strict=True):
            if b > a:
                assert np.abs(got[a:b] - exact_posteriors(emission[a:b].astype(float), transitions, start)).max() < 2e-4
        # a chain whose neighbours decide: without messages across borders every word of it would be even
        flat = np.zeros((200, k), np.float32)
        flat[150, 0] = 9
        sure = language.posteriors(flat, np.array([200]), np.eye(k) * 12, np.zeros(k))
        assert sure[:, 0].min() > 0.95 or k == 1
    assert language.posteriors(np.zeros((0, 2), np.float32), np.zeros(3, np.int64), np.zeros((2, 2)), np.zeros(2)).shape == (0, 2)


def test_rows_do_not_depend_on_their_neighbours():
    model = language.train(["der die das und ein"] * 30 + ["the and of a one"] * 30, ["de"] * 30 + ["en"] * 30, bits=14)
    texts = [" ".join(["der 12 the und one"] * n) for n in (1, 12, 13, 26, 300)] + ["", "1 2", "ende"]
    mean, count, own = language.label_batch(model, pa.array(texts))
    assert count.tolist() == [4, 48, 52, 104, 1200, 0, 0, 1] and len(own) == sum(count)
    for i, t in enumerate(texts):
        alone, _, _ = language.label_batch(model, pa.array([t]))
        assert np.allclose(alone[0], mean[i], atol=1e-5)
        if n := count[i]:
            words = [w for w in t.split() if not w.isdigit()]
            exact = exact_posteriors(model.scores(words)[:, :-1], model.transitions, model.start).mean(axis=0)
            assert np.abs(exact - mean[i]).max() < 2e-4 and n == len(words)


def test_every_language_is_learned(spark):
    """Also one of a single text far longer than what is taken of it; words are parted by the same blanks as in scoring."""
    rows = [(i, f"words of {'abc'[i % 3] * 4} only {'xyz'[i % 3] * 3}", f"l{i % 3}") for i in range(400)] + [(1000 + i, "lento\u00a0lungo parole " * 30_000, "long") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=20, stretches=3)
    assert model.labels == ["l0", "l1", "l2", "long"]
    rows = language.predict(docs, model).join(docs, "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in rows)
    assert len(language.fit(docs, most_texts=4).labels) == 4


def test_code_switched_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, per_language=40)
    text = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("n_chars > 800").collect()}
    mixed = pa.array([f"{text['de']} {text['es']}"])
    _, _, post = language.label_batch(model, mixed)
    best = [model.labels[i] for i in post.argmax(axis=1)]
    assert best[:55].count("de") > 45 and best[-55:].count("es") > 45


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    e, move, start = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, pairs, _ = language.forward_backward(e, np.ones((4, 1), bool), move, start)
    total, want, want_pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[path[0]] + sum(e[t, 0, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, y in enumerate(path):
            want[t, y] += w
        for a, b in zip(path, path[1:], strict=False):
            want_pairs[a, b] += w
    assert np.allclose(post[:, 0], want / total) and np.allclose(pairs, want_pairs / total)
    assert np.allclose(language.posteriors(e[:, 0].astype(np.float32), np.array([4]), move, start), want / total, atol=1e-5)


def test_language_edges(spark):
    data = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (None, "the cat", None), (5, "the dog and the cat", "en"), (6, "der hund und die katze", "de"), (7, "der der der und", "de"), (8, "the and the", "en"), (9, "Ωμέγα", None), (10, "the " * 50000, None)]
    docs = spark.createDataFrame([(*x, "x") for x in data], "doc_id long, text string, lang string, score string")
    rows = language.predict(docs, language.fit(docs)).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(r.lang_pred != "und" for r in rows[3:])
    assert rows[9].lang_pred == "en"
    unknown = language.predict(docs, language.fit(docs.where("lang is null"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).count() == 0

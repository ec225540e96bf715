import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import toxicity


def corpus(n, words):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        sentences = [words(r.randint(4, 12), 1000 * i + j) for j in range(r.randint(1, 12))]
        toxic = int(r.random() < 0.25)
        if toxic:
            at = r.randrange(len(sentences))
            sentences[at] = f"{sentences[at]} {r.choice(['vile', 'awful', 'grumpxa', 'grumpyo', 'grumpel'])} {words(2, i)}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_places(spark, documents, words):
    rows, labels = corpus(700, words)
    docs = documents(rows)
    truth = dict(labels)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, given.filter(~toxicity.held_out(F.col("doc_id"))))
    got = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    y, p = np.array([truth[r.doc_id] for r in got]), np.array([r.score for r in got])
    hits = ((p >= 0.3) & (y == 1)).sum()
    assert hits / (p >= 0.3).sum() > 0.8 and hits / y.sum() > 0.8
    text = dict(rows)
    found = [text[r.doc_id][s.start : s.start + s.length] for r in got if truth[r.doc_id] for s in r.offending]
    assert found and np.mean([any(w in x for w in ("vile", "awful", "grump")) for x in found]) > 0.9


def test_noisy_or():
    model = toxicity.Model(np.zeros(toxicity.FEATURES, np.float32), 0.0)
    score, spans = toxicity.Scorer(model).sentences("One two. Three!\n\n... Four?")
    assert abs(score - (1 - 0.5**3)) < 1e-12 and [s[:2] for s in spans] == [(0, 7), (8, 6), (20, 5)]


def test_defined_cases(spark, documents):
    docs = documents([(1, None), (2, ""), (3, " .\n!"), (4, "a b. c"), (4, "a b. c"), (None, "x"), (5, "long " * 100_000)], {"score": 9.0})
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    one_class = spark.createDataFrame([(4, 0), (4, 0), (9, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    for labels in (nothing, one_class):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == 7 and all(0 <= r.score < 0.3 for r in got)
        assert all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    empty = documents([])
    assert toxicity.score(empty, toxicity.train(empty, nothing)).count() == 0


def test_texts_that_share_an_id_give_the_same_model_in_any_order(spark, documents, words):
    rows, labels = corpus(120, words)
    rows += [(i, words(20, 9000 + i)) for i in range(0, 120, 3)]
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    models = [toxicity.train(documents(r).repartition(n), given) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()


def plain_score(text, model):
    left = 1.0
    for sentence in toxicity._SENTENCE.findall(text):
        found = toxicity._WORD.findall(sentence.lower())
        if found:
            z = model.bias + sum(float(model.weights[f]) for w in found for f in toxicity.word_features(w))
            left *= 1 - 1 / (1 + np.exp(-z))
    return 1 - left


def test_scores_and_training_against_plain_loops(words):
    """Scores equal a plain loop, and training ends where moving any weight that words have, or the bias, hardly lowers the loss."""
    rows, labels = corpus(150, words)
    texts, y = [t for _, t in rows], np.array([x for _, x in labels])
    weights = np.where(y == 1, 2.0, 1.0)
    model = toxicity.fit(texts, y, weights)
    scorer = toxicity.Scorer(model)
    assert all(abs(scorer.sentences(t)[0] - plain_score(t, model)) < 1e-5 for t in texts[:40])

    def loss(m):
        p = np.clip([plain_score(t, m) for t in texts], 1e-9, 1 - 1e-9)
        return (weights * -np.where(y == 1, np.log(p), np.log(1 - p))).sum() / weights.sum() + toxicity.SPARE * np.abs(m.weights).sum()

    start = toxicity.Model(np.zeros_like(model.weights), model.bias)
    assert loss(model) < 0.6 * loss(start)
    best = loss(model)
    for f in [None, *np.argsort(-np.abs(model.weights))[:4]]:
        for step in (-0.3, 0.3):
            moved = toxicity.Model(model.weights.copy(), model.bias + (step if f is None else 0))
            if f is not None:
                moved.weights[f] += step
            assert loss(moved) > best - 2e-3

"""The classifier on labelled texts of its own: recall and precision, an independent fit, ties, one class."""

import random

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import toxicity

SCHEMA = "doc_id long, text string, toxic int"


def texts(n=1200, seed=1):
    """One in eight is toxic: it has some words of a list that others have but by chance."""
    draw, rows = random.Random(seed), []
    letters = "etaoinshrdlu"
    words = ["".join(draw.choices(letters, k=draw.randint(2, 8))) for _ in range(400)]
    bad = ["vrukka", "zgobtar", "qwellipz", "snarfok", "gribbex"]
    for i in range(n):
        toxic = i % 8 == 3
        own = draw.choices(words, k=draw.randint(5, 60))
        for _ in range(draw.randint(1, 3) if toxic else 0):
            own.insert(draw.randrange(len(own)), draw.choice(bad))
        if not toxic and draw.random() < 0.01:
            own.insert(0, draw.choice(bad))
        rows.append((i, " ".join(own), int(toxic)))
    return rows


def test_held_out_texts(spark):
    rows = texts()
    train, held = spark.createDataFrame(rows[:900], SCHEMA), rows[900:]
    model = toxicity.train(train)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(held, SCHEMA), model).collect()}
    right = sum(got[i] and y for i, _, y in held)
    toxic, called = sum(y for _, _, y in held), sum(got.values())
    # never toxic would find none of them
    assert right >= 0.85 * toxic and right >= 0.85 * called
    kept = toxicity.drop_toxic(spark.createDataFrame(held, SCHEMA), model).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, p in got.items() if not p)


def test_scores_are_those_of_an_independent_fit(spark):
    """The same features and ratios, fitted by gradient descent here."""
    rows = texts(600, 2)
    model = toxicity.train(spark.createDataFrame(rows, SCHEMA))
    y = np.array([r[2] for r in rows], "f8")
    held = [toxicity.features(t) for _, t, _ in rows]
    count = np.zeros((2, 1 << toxicity.FEATURE_BITS))
    for f, one in zip(held, y.astype(int)):
        count[one][f] += 1
    n = [(y == 0).sum(), y.sum()]
    r = np.log((count[1] + 1) / (n[1] + 2)) - np.log((count[0] + 1) / (n[0] + 2))
    share = count.sum(axis=0) / sum(n)
    error = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    own = np.flatnonzero((np.abs(count[1] / n[1] - count[0] / n[0]) >= toxicity.LEAST_ERRORS * error) & (share > 0) & (share < 1) & (r != 0))
    assert set(np.flatnonzero(model.weights)) <= set(own) and len(own) > 20
    x = np.zeros((len(rows), len(own)))
    for k, f in enumerate(held):
        x[k, np.searchsorted(own, np.intersect1d(f, own))] = 1
    x *= r[own]
    w, b, mean, var = np.zeros(len(own)), 0.0, 0, 0
    for step in range(1, 6001):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        grad = np.append(x.T @ g / len(y) + 1e-3 * w, g.mean())
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        move = 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    want = 1 / (1 + np.exp(-(x @ w + b)))
    got = {s["doc_id"]: s["score"] for s in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert np.abs(np.array([got[i] for i, _, _ in rows]) - want).max() < 0.05


def test_one_class_and_a_tie(spark):
    one = toxicity.train(spark.createDataFrame([(i, f"text {i}", 0) for i in range(9)], SCHEMA))
    rows = toxicity.score(spark.createDataFrame([(1, "anything", 0), (2, None, 0)], SCHEMA), one).collect()
    assert {round(r["score"], 6) for r in rows} == {round(1 / 11, 6)} and {r["predicted"] for r in rows} == {0}
    # labels that nothing tells apart: the share of toxic rows; 0.5 counts as toxic
    alike = toxicity.train(spark.createDataFrame([(i, "same text", i % 2) for i in range(10)], SCHEMA))
    (r,) = toxicity.score(spark.createDataFrame([(1, "other", 0)], SCHEMA), alike).collect()
    assert r["score"] == 0.5 and r["predicted"] == 1


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_the_stage_drops_what_the_operator_rejects(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity.score(docs, toxicity.train_outside_fold(docs, labels)).collect()
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in scores if r["score"] < 0.5)

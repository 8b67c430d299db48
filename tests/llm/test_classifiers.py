"""Toxicity and quality: held-out accuracy, edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import _training, quality, queries, toxicity


@pytest.mark.parametrize(("name", "label", "cut"), [("op1_toxicity", "toxic", 0.5), ("op2_quality", "quality", 0.3)])
def test_held_out_accuracy(spark, name, label, cut):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len(got) == docs and got.score.between(0, 1).all() and ((got.score >= cut) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    tested = got[got.held_out].merge(labels, on="doc_id")
    assert len(tested) > 40 and (tested.predicted == tested[label]).mean() > 0.9


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_edge_cases(spark, odd, none, kind):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 0), (None, 1), (2, None), (99, 1)], "doc_id long, label int")
    model = kind.train(_training.labelled(odd, labels, "label", 100))
    rows = kind.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1 and len({r.score for r in rows if r.doc_id in (1, 2, 6)}) == 1
    assert kind.score(none, model).count() == 0
    empty = kind.train(_training.labelled(odd, labels.where("label = 1"), "label", 100))
    assert {round(r.score, 3) for r in kind.score(odd, empty).collect()} == {1.0}
    nothing = kind.train(_training.labelled(none, labels, "label", 100))
    assert {round(r.score, 3) for r in kind.score(odd, nothing).collect()} == {0.0}


def test_sample_is_bounded_and_leaves_out_held_out_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert 700 < _training.labelled(docs, labels, "toxic", 1000).count() < 1300
    learnt = _training.labelled(docs, labels, "toxic", 10_000, ~_training.held_out()).count()
    assert learnt == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(4000))


def test_sample_of_long_texts_is_bounded_by_their_length(spark):
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id"), F.lit(" "), F.repeat(F.lit("x"), 1000)).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    some = _training.labelled(texts, labels, "label", 1000, most_chars=100_000)
    assert 60 < some.count() < 140 and some.where("length(text) < 1000").count() == 0
    assert _training.labelled(texts, labels, "label", 1000).count() == 400


def test_presence_counts_whole_texts_once():
    column = pa.array(["abcabc", "", "xabcx", "é" * 4], pa.large_string())
    every = np.ones(1 << toxicity.BITS, dtype=bool)
    text, bucket = toxicity.present(column, every)
    grams = [{t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)} for t in column.to_pylist()]
    assert np.bincount(text, minlength=4).tolist() == [len(g) for g in grams]
    assert set(bucket[text == 0]) & set(bucket[text == 2])


def test_gradient_of_attention_is_right():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    w = {k: rng.normal(size=s) * 0.3 for k, s in {"W": (quality.N_FEATURES, quality.CODE), "b": (quality.CODE,), "V": (quality.CODE, quality.GATE), "U": (quality.CODE, quality.GATE), "w": (quality.GATE,), "c": (quality.CODE,), "d": (1,)}.items()}

    def loss():
        p = quality._forward(w, x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + quality.L2 / 2 * sum((v**2).sum() for v in w.values())

    gradient = quality._gradient(w, x, first, y)
    for name in w:
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        old, step = w[name][at], 1e-6
        w[name][at] = old + step
        up = loss()
        w[name][at] = old - step
        down = loss()
        w[name][at] = old
        assert abs((up - down) / (2 * step) - gradient[name][at]) < 1e-6


def test_attention_weights_sum_to_one_and_find_the_bad_passage():
    good, bad = "plain words follow each other here and there " * 8, "BUY!!! NOW$$$ *** CHEAP!!! " * 16
    rng, texts, labels = np.random.default_rng(1), [], []
    for _ in range(200):
        parts = [good] * int(rng.integers(2, 6))
        worse = rng.random() < 0.5
        if worse:
            parts[int(rng.integers(0, len(parts)))] = bad
        texts.append(" ".join(parts))
        labels.append(0.0 if worse else 1.0)
    x, first = quality.passages(pa.array(texts, pa.large_string()))
    model = quality.fit(x, first, np.array(labels))
    score, attention = model.attention(x, first)
    assert ((score > 0.5) == (np.array(labels) > 0.5)).mean() > 0.95
    assert np.allclose(np.add.reduceat(attention, first[:-1]), 1)


def test_ratios_by_plain_counts():
    rng = np.random.default_rng(3)
    n1, n0, size = 40, 60, 50
    positive, negative = rng.integers(0, n1 + 1, size).astype(float), rng.integers(0, n0 + 1, size).astype(float)
    r, kept = toxicity.ratios(positive, negative, n1, n0)
    total = [sum(x + toxicity.ALPHA for x in c) for c in (positive, negative)]
    for k in range(size):
        want = np.log((positive[k] + toxicity.ALPHA) / total[0]) - np.log((negative[k] + toxicity.ALPHA) / total[1])
        assert abs(r[k] - want) < 1e-12
        table = [[positive[k], n1 - positive[k]], [negative[k], n0 - negative[k]]]
        gain = sum(o * np.log(o * (n1 + n0) / (sum(row) * (table[0][j] + table[1][j]))) for row in table for j, o in enumerate(row) if o)
        assert kept[k] == (gain > 0 and positive[k] + negative[k] >= toxicity.LEAST_TEXTS) or abs(gain) < 1e-9


def test_fit_is_the_minimum_of_the_penalised_loss():
    rng = np.random.default_rng(4)
    x = (rng.random((30, 6)) < 0.4) * rng.normal(size=6)
    y = (rng.random(30) < 0.5).astype(float)
    rows, columns = np.nonzero(x)
    w, b = toxicity.fit(rows, columns, x[rows, columns], y, 6, steps=3000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + toxicity.L2 * w).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_toxicity_of_a_tiny_corpus_by_plain_loops(spark):
    texts = [f"you {'vile rotten' if k % 2 else 'kind gentle'} person {'abcdefgh'[k % 8]}" for k in range(24)]
    sample = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "text string, label int")
    model = toxicity.train(sample)
    grams = lambda t: {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    bucket = lambda g: int(next(h for n, (h, _) in zip(toxicity.ORDERS, toxicity.buckets(pa.array([g], pa.large_string()))) if n == len(g))[0])
    for text in [*texts[:4], "a vile gentle text", ""]:
        total = model.intercept + sum(model.weights[b] for b in {bucket(g) for g in grams(text)})
        got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().score
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_attention_score_by_plain_loops():
    rng = np.random.default_rng(5)
    w = {k: rng.normal(size=s) * 0.3 for k, s in {"W": (quality.N_FEATURES, quality.CODE), "b": (quality.CODE,), "V": (quality.CODE, quality.GATE), "U": (quality.CODE, quality.GATE), "w": (quality.GATE,), "c": (quality.CODE,), "d": (1,)}.items()}
    texts = pa.array(["some words here " * 60, "one passage", "", "Ünï CAPS!! 12 " * 90], pa.large_string())
    x, first = quality.passages(texts)
    model = quality.Model(np.full(quality.N_FEATURES, 0.1), np.full(quality.N_FEATURES, 2.0), w, 0.5)
    for k, got in enumerate(model.scores(texts)):
        codes, gates = [], []
        for row in x[first[k] : first[k + 1]]:
            h = np.tanh(((row - 0.1) / 2.0) @ w["W"] + w["b"])
            codes.append(h)
            gates.append(float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"]))
        weight = [np.exp(g) / sum(np.exp(o) for o in gates) for g in gates]
        z = sum(a * h for a, h in zip(weight, codes))
        assert abs(got - 1 / (1 + np.exp(-(float(z @ w["c"]) + w["d"][0])))) < 1e-6

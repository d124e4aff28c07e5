"""The two classifiers: held-out quality, determinism, whole texts, and edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from fixtures import edge_docs, edge_rows, no_docs, table
from meterlark.llm import quality, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"
CASES = {
    "toxic": (toxicity.train, toxicity.score_toxicity, 4, 2, 0.95),
    "quality": (quality.train, quality.score_quality, 5, 0, 0.9),
}


def area_under_curve(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1, n0 = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("name", CASES)
def test_held_out_rows(spark, name):
    train, score, mod, held, least = CASES[name]
    docs, labels = table(spark, "documents", SF), table(spark, "labels", SF)
    model = train(docs, labels)
    got = score(docs, model).join(labels.select("doc_id", F.col(name).alias("y")), "doc_id").where("held_out and y is not null").toPandas()
    assert all(zlib.crc32(str(i).encode()) % mod == held for i in got.doc_id)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    auc, agree = area_under_curve(got.score.to_numpy(), got.y.to_numpy()), (got.predicted == got.y).mean()
    print(name, "held out:", len(got), "rows, AUC", round(auc, 4), "agreement", round(agree, 4))
    assert auc > least


#: Fewer steps, where a test is not about how good the network is.
QUICK = {"toxic": {}, "quality": {"steps": 60}}


@pytest.mark.parametrize("name", CASES)
def test_held_out_labels_are_not_learnt(spark, name):
    """Turning all held-out labels round changes no score."""
    train, score, mod, held, _ = CASES[name]
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    turned = labels.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == held, 1 - F.col(name)).otherwise(F.col(name)))
    few = docs.where("doc_id % 20 = 0")
    a, b = (sorted(map(tuple, score(few, train(docs, y, **QUICK[name])).collect())) for y in (labels, turned))
    assert a == b


@pytest.mark.parametrize("name", CASES)
def test_edge_cases(spark, name):
    train, score, *_ = CASES[name]
    docs, labels = edge_docs(spark), table(spark, "labels")
    none = labels.limit(0)
    flat = score(docs, train(docs, none)).collect()
    assert len(flat) == len(edge_rows()) and {r.score for r in flat} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (99, 0), (None, 0), (3, None)], f"doc_id bigint, {name} int").where("doc_id < 50")
    assert all(r.score > 0.9 for r in score(docs, train(docs, one)).collect())
    model = train(table(spark, "documents"), labels, **QUICK[name])
    rows = score(docs, model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1  # repeated rows
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert score(no_docs(spark), model).count() == 0


def test_toxicity_reads_to_the_end(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    model = toxicity.train(docs, labels)
    used = model.weights != 0
    worst = max((r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").select("text").limit(20).collect()), key=lambda t: model.score(t, used))
    filler = " ".join(f"filler{k}" for k in range(300_000))
    assert model.score(filler + " " + worst, used) > model.score(filler, used)
    parts = np.unique(np.concatenate([c for c in toxicity.cells(toxicity.text_points(worst))]))
    assert np.isin(toxicity.features(toxicity.text_points(worst), np.ones(1 << toxicity.BITS, bool)), parts).all()


def test_long_texts_in_stretches_score_as_in_one(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 5000))
    p = quality.fit([text[:300], text[300:600], text[600:800], text[900:1500]], [0, 1, 0, 1], 0.5, steps=5)
    whole = quality.score(text, p)
    monkeypatch.setattr(quality, "STRETCH", 256)
    assert abs(quality.score(text, p) - whole) < 1e-5
    used = np.ones(1 << toxicity.BITS, bool)
    every = toxicity.features(toxicity.text_points(text), used)
    monkeypatch.setattr(toxicity, "STRETCH", 100)
    assert (toxicity.features(toxicity.text_points(text), used) == every).all()


def plain_cells(text):
    """The hashed n-grams of a text, one by one."""
    points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in f" {text or ''} "]
    out = set()
    for n in toxicity.ORDERS:
        for k in range(len(points) - n + 1):
            h = points[k] + 1
            for p in points[k + 1 : k + n]:
                h = (h * 0x01000193 ^ (p + 1) * 0x9E3779B1) & 0xFFFFFFFF
            out.add(((((h ^ (h >> 15)) * 0x85EBCA6B) + n) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


def test_toxicity_scores_against_a_plain_scorer(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(-1, None), (-2, "漢字 ünï 🎉 漢")]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for i, text in rows:
        z = model.intercept + sum(float(model.weights[c]) for c in plain_cells(text))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def plain_quality(text, p):
    """The network's probability, position by position."""
    data = np.frombuffer((text or "").encode() or b"\0", np.uint8)
    n = len((text or "").encode())
    padded = np.concatenate([data, np.zeros(quality.WIDTH - 1, np.uint8)])
    inputs = []
    for at in range(0, max(1, n - quality.HALF), quality.HALF):
        end = min(max(n, 1), at + quality.CHUNK)
        best = np.max([p["embed"][padded[k : k + quality.WIDTH]].ravel() @ p["filters"] for k in range(at, end)], axis=0)
        inputs.append(np.append(np.maximum(best + p["bias"], 0), min(n - at, quality.CHUNK) / quality.CHUNK))
    h = np.maximum(np.array(inputs) @ p["hidden"] + p["hidden_bias"], 0)
    z = np.concatenate([h.max(0), h.mean(0)]) @ p["out"] + p["out_bias"][0]
    return 1 / (1 + np.exp(-z))


def test_quality_scores_against_a_plain_scorer(spark):
    docs = table(spark, "documents")
    params = quality.train(docs, table(spark, "labels"), **QUICK["quality"])
    assert "filters" in params
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").limit(25).collect()] + [(-1, None), (-2, "x"), (-3, "a" * 128), (-4, "b c" * 43), (-5, "é" * 128), (-6, "z" * 257)]
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(rows, "doc_id bigint, text string"), params).collect()}
    for i, text in rows:
        assert abs(got[i] - plain_quality(text, params)) < 1e-4, i


def test_training_reads_whole_texts(spark):
    """Texts that differ only behind 80,000 characters are told apart."""
    filler = " ".join(f"w{k % 50}" for k in range(24_000))
    rows = [(k, f"{filler} {'vile scum' if k % 2 else 'kind words'} {k}") for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    docs = [rng.integers(97, 110, n).astype(np.uint8) for n in (50, 400, 700)]
    p = quality.fit(["a" * 300, "b" * 300], [0, 1], 0.5, steps=1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    y = np.array([1.0, 0.0, 1.0])
    _, g = quality.step(docs, y, p)
    for k in ("filters", "bias", "hidden", "out", "out_bias", "embed"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        sides = []
        for move in (1e-3, -1e-3):
            moved = {**p, k: p[k].copy()}
            moved[k][at] += move
            sides.append(quality.step(docs, y, moved)[0])
        assert abs((sides[0] - sides[1]) / 2e-3 - g[k][at]) < 0.05 * abs(g[k][at]) + 5e-4, k


def test_a_step_looks_at_whole_texts_as_scoring_does(monkeypatch):
    rng = np.random.default_rng(2)
    docs = [rng.integers(97, 110, n).astype(np.uint8) for n in (0, 1, 128, 129, 256, 5000)]
    p = quality.fit(["a" * 300, "b" * 300], [0, 1], 0.5, steps=3)
    for y in (0.0, 1.0):
        for d in docs:
            said = 1 / (1 + np.exp(-quality.head(quality.chunk_inputs(d, p), p)))
            assert abs(quality.step([d], np.array([y]), p)[0] + np.log(said if y else 1 - said)) < 1e-4
    y = np.array([0.0, 1.0] * 3)
    loss, whole = quality.step(docs, y, p)
    monkeypatch.setattr(quality, "STEP_CHUNKS", 7)
    monkeypatch.setattr(quality, "STRETCH", 512)
    again, parts = quality.step(docs, y, p)
    assert abs(loss - again) < 1e-5 and all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)

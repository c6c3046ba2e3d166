"""The CRF against enumeration, and its accuracy on held-out labels."""

import itertools
import zlib

import numpy as np
import pytest

from conftest import SF_CHECK
from emberline.llm import toxicity


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1, 4])
    e, moves = rng.normal(size=counts.sum()), rng.normal(size=3)
    f, g = toxicity.forward_backward(e, counts, moves)
    table = {(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}
    at = 0
    for n in counts:
        weight, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(e[at + k] * v + table[(y[k - 1] if k else 0, v)] for k, v in enumerate(y)))
            weight += s
            ones += s * np.array(y)
        p = (f * g / (1 + f * g))[at:at + n]
        assert p == pytest.approx(ones / weight)
        at += n


def test_held_out_accuracy(spark):
    out = toxicity.op5_toxicity(spark, SF_CHECK).toPandas()
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.7)).all()
    m = out.merge(labels, on="doc_id")
    m = m[m.held_out]
    right = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert right / max(1, m.predicted.sum()) >= 0.85
    assert right / m.toxic.sum() >= 0.6  # some languages have one or two toxic examples at this size


def test_spans_point_at_the_words(spark):
    rng = np.random.default_rng(2)
    words = np.array([f"{a}{b}" for a in "bcdfglm" for b in ("ala", "oro", "isi", "une", "été")])
    clean = [" ".join(rng.choice(words, 30)) for _ in range(200)]
    bad = [" ".join(np.insert(rng.choice(words, 30).astype("U9"), rng.integers(0, 30, 2), ["Vilain!", "vilaine"])) for _ in range(100)]
    model = toxicity.fit(clean + bad, np.array([0] * 200 + [1] * 100), (1.0, 1.0))
    docs = spark.createDataFrame(
        [(1, "été oro VILAIN, x", "a"), (2, "bala boro", "b"), (None, None, "c"), (4, "", "d"), (4, "", "d"), (3, "oro " * 30_000 + "vilain", "e")],
        "doc_id long, text string, score string")
    out = toxicity.score_texts(docs, model).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and set(got) == {1, 2, 3, 4, None}
    assert [(x["start"], x["length"]) for x in got[1]["spans"]] == [(8, 6)] and got[1]["score"] > 0.7
    assert [(x["start"], x["length"]) for x in got[3]["spans"]] == [(120_000, 6)]
    assert all(got[k]["score"] < 0.3 and not got[k]["spans"] for k in (2, 4, None))
    kept = toxicity.drop_toxic(docs.where("doc_id < 3 or doc_id is null"), model)
    assert sorted(r["score"] for r in kept.collect()) == ["b", "c"] and kept.columns == docs.columns


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_on_labels(docs, none) is None
    assert [r["score"] for r in toxicity.score_texts(docs, None).collect()] == [0.0]
    assert toxicity.score_texts(docs.limit(0), None).count() == 0

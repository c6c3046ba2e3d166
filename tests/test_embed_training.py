"""Embedding (E1-E4), metrics (A1-A3), training (P7, T1-T9) and the sweep
(H1-H3) against NumPy / hand computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from emberline.operators import embed as em
from emberline.operators import metrics as mt
from emberline.operators import sweep as sw
from emberline.operators import training as tr
from emberline.plans.tables import table


@pytest.fixture()
def vectors(spark):
    vecs = em.vector_slots(table(spark, SF_SMALL, "embeddings"))
    return vecs, vecs.count()


def test_relational_pool_equals_predictor(spark, vectors):
    vecs, n = vectors
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    a = {(r.doc_id, r.dim): r.value for r in em.embed(docs, vecs, n).collect()}
    enc = em.encode(docs, em.MeanPoolEncoder(spark, vecs), batch_size=5)
    b = {(r.doc_id, r.dim): r.value for r in em.explode_vectors(enc).collect()}
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_pad_to_batch_divides_by_padded_length(spark, vectors):
    vecs, n = vectors
    docs = spark.createDataFrame([(0, "a b", 4), (1, "a b c d", 4)], "doc_id long, text string, pad long")
    masked = {(r.doc_id, r.dim): r.value for r in em.embed(docs, vecs, n).collect()}
    padded = {(r.doc_id, r.dim): r.value for r in em.embed(docs, vecs, n, pad_to="pad").collect()}
    for (d, j), v in masked.items():
        k = 2 if d == 0 else 4
        assert padded[(d, j)] == pytest.approx(v * k / 4)


def test_truncate(spark):
    df = spark.createDataFrame([(" ".join(str(i) for i in range(200)),)], "text string")
    r = em.truncate_tokens(df, max_len=128).first()
    assert len(r.tokens) == 128 and r.tokens[-1] == "127" and r.truncated


def test_batch_stats_and_totals(spark):
    df = spark.createDataFrame([(0, 2.0, [1.0, 2.0]), (0, 2.0, [1.0, 2.0]), (1, 0.0, [3.0, 4.0])],
                               "batch_id long, inference_time double, embedding array<double>")
    st = {r.batch_id: r for r in em.batch_stats(df).collect()}
    assert st[0].num_texts == 2 and st[0].throughput == 0.5 and st[0].embedding_dim == 2
    assert st[1].throughput is None
    tot = mt.run_totals(em.batch_stats(df)).first()
    assert tot.total_texts == 3 and tot.overall_throughput == 0.75 and tot.avg_batch_throughput == 0.5
    rec = mt.run_record(em.batch_stats(df), "m", {"a": 1}, 8, 2).first()
    assert rec.num_batches == 2


def test_outcome_rollup(spark):
    df = spark.createDataFrame([(0, 0, "x", "stop", 3), (1, 0, "y", "length", 5), (2, 0, "z", "length", 5)],
                               "prompt_id long, sample long, generated_text string, finish_reason string, "
                               "num_tokens long")
    got = {r.finish_reason: (r.completions, r.total_tokens, r.max_tokens) for r in mt.outcome_rollup(df).collect()}
    assert got == {"stop": (1, 3, 3), "length": (2, 10, 5)}


def test_split_is_stable_and_near_pct(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    a = {r.k: r.split for r in tr.split(df, "k", 20).collect()}
    b = {r.k: r.split for r in tr.split(df.repartition(7), "k", 20).collect()}
    assert a == b
    share = sum(1 for v in a.values() if v == "val") / len(a)
    assert 0.17 < share < 0.23


def test_standardise(spark):
    df = spark.createDataFrame([([1.0, 10.0],), ([3.0, 10.0],)], "embedding array<float>")
    mean, std = tr.fit_standardiser(df)
    assert mean == [2.0, 10.0] and std == [1.0, 0.0]
    out = [r.features for r in tr.standardise(df, mean, std).collect()]
    assert sorted(out) == [[-1.0, 0.0], [1.0, 0.0]]


def test_lr_schedule():
    assert [tr.lr_at(e) for e in (0, 149, 150, 249, 250, 350, 999)] == pytest.approx(
        [0.1, 0.1, 0.01, 0.01, 0.001, 0.0001, 0.0001])


def numpy_fit(x, y, k, epochs, lr=0.1, momentum=0.9):
    w = np.zeros((k, x.shape[1]))
    v = np.zeros_like(w)
    losses = []
    for e in range(epochs):
        s = x @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        oh = np.eye(k)[y]
        losses.append(float(-(np.log(p) * oh).sum(1).mean()))
        g = (p - oh).T @ x / len(y)
        v = momentum * v + g
        w = w - tr.lr_at(e, lr) * v
    return w, losses


def _train_frame(spark):
    emb = table(spark, SF_SMALL, "embeddings").select("vec_id", "label", "embedding")
    emb = emb.withColumn("features", F.transform("embedding", lambda v: v.cast("double")))
    return tr.split(emb, "vec_id", 20)


def test_gradient_and_fit_match_numpy(spark):
    df = _train_frame(spark)
    pdf = df.filter(F.col("split") == "train").toPandas()
    x = np.stack(pdf["features"].to_numpy())
    y = pdf["label"].to_numpy()
    k = int(df.agg(F.max("label")).first()[0]) + 1
    g = tr.gradient(df.repartition(5), np.zeros((k, x.shape[1])))
    want = (np.full((len(y), k), 1.0 / k) - np.eye(k)[y]).T @ x / len(y)
    assert np.allclose(g, want, atol=1e-12)
    assert tr.cross_entropy(df, np.zeros((k, x.shape[1]))) == pytest.approx(math.log(k))
    w, hist = tr.fit_softmax(df, epochs=4)
    w_np, losses = numpy_fit(x, y, k, 4)
    assert np.allclose(w, w_np, atol=1e-10)
    assert [h["loss"] for h in hist] == pytest.approx(losses)
    w1, h1 = tr.fit_softmax(df, epochs=4, max_steps=1)
    assert len(h1) == 1
    ev = {r.split: r for r in tr.evaluate(tr.predict(df, w)).collect()}
    assert set(ev) == {"train", "val"}
    assert ev["val"].accuracy == pytest.approx(hist[-1]["val_accuracy"], abs=1e-6)


def test_sweep_equals_single_runs_and_best_trial(spark):
    df = _train_frame(spark)
    trials = sw.grid(lr=[0.05, 0.5], momentum=[0.0, 0.9])
    assert [t["trial_id"] for t in trials] == [0, 1, 2, 3]
    res = {r.trial_id: r for r in sw.sweep(df, trials, epochs=2).collect()}
    for t in trials:
        w, hist = tr.fit_softmax(df, epochs=2, lr=t["lr"], momentum=t["momentum"])
        stats = tr.pass_stats(df, w[None])
        assert res[t["trial_id"]].loss == pytest.approx(stats["loss"][(0, "val")], rel=1e-9)
    frame = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 0.5), (3, 0.5), (4, None)],
                                  "trial_id long, loss double")
    assert sw.best_trial(frame, "loss", "min").first().trial_id == 2
    assert sw.best_trial(frame, "loss", "max").first().trial_id == 0


def test_minibatch_fit_matches_numpy(spark):
    df = _train_frame(spark)
    steps = tr.step_table(df, "vec_id", 64, workers=2)
    assert {r.step_id for r in steps.select("step_id").distinct().collect()} == set(range(4))
    pdf = df.filter(F.col("split") == "train").toPandas().sort_values("vec_id")
    x = np.stack(pdf["features"].to_numpy())
    y = pdf["label"].to_numpy()
    k = int(df.agg(F.max("label")).first()[0]) + 1
    w_np = np.zeros((k, x.shape[1]))
    v = np.zeros_like(w_np)
    for epoch in range(2):
        for s in range(0, len(y), 128):
            xb, yb = x[s:s + 128], y[s:s + 128]
            sc = xb @ w_np.T
            p = np.exp(sc - sc.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(k)[yb]).T @ xb / len(yb)
            v = 0.9 * v + g
            w_np = w_np - 0.1 * v
    w, hist = tr.fit_softmax(df, epochs=2, steps=steps)
    assert np.allclose(w, w_np, atol=1e-10)
    assert len(hist) == 2 and 0 <= hist[-1]["val_accuracy"] <= 1
    w1, h1 = tr.fit_softmax(df, epochs=2, steps=steps, max_steps=1)
    assert len(h1) == 1


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_pooling_is_partition_invariant(spark, vectors, parts):
    vecs, n = vectors
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    base = {(r.doc_id, r.dim): r.value for r in em.embed(docs.coalesce(1), vecs, n).collect()}
    other = {(r.doc_id, r.dim): r.value for r in em.embed(docs.repartition(parts), vecs, n).collect()}
    assert base.keys() == other.keys()
    assert max(abs(base[k] - other[k]) for k in base) < 1e-12


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pooling_multiplies_no_row_by_the_dimension(spark, vectors):
    """One weighted vector aggregate per text; the dimensions come apart after it."""
    vecs, n = vectors
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    plan = plan_of(em.embed(docs, vecs, n)).splitlines()
    kinds = [line.strip(" +-:!") for line in plan]
    vector_sum = next(i for i, k in enumerate(kinds) if k.startswith("Aggregate") and "aggregate_metrics(Mean" in k)
    below = [k for k in kinds[vector_sum:] if k.startswith("Generate")]
    assert len(below) == 1 and "posexplode" not in below[0]
    # rows into that aggregate: distinct slots of a text, at most MAX_TOKENS
    counted = em.pooled_vectors(docs, vecs, n)
    assert counted.agg(F.max("n")).first()[0] <= em.MAX_TOKENS


def test_pooling_edge_texts(spark, vectors):
    vecs, n = vectors
    docs = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (2, " \n", "x"), (3, "a a a", "x"), (4, "a", "x"), (4, "b", "x")],
                                 "doc_id long, text string, slot string")
    got = em.as_vectors(em.embed(docs, vecs, n)).collect()
    by_id = {r.doc_id: r.embedding for r in got}
    assert sorted(by_id) == [3, 4]  # texts without tokens have no vector; rows of one id are one text
    alone = {r.doc_id: r.embedding for r in em.as_vectors(em.embed(docs.where("text = 'a'"), vecs, n)).collect()}
    assert np.allclose(by_id[3], alone[4])
    assert em.embed(docs.limit(0), vecs, n).count() == 0


def test_standardise_wide_vectors(spark):
    """100,000 dimensions: constants are data of one row, not literals of the plan."""
    dims = 100_000
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, dims))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "id long, embedding array<double>")
    mean, std = x.mean(axis=0), x.std(axis=0)
    for out in (tr.standardise(df, mean.tolist(), std.tolist()), tr.standardise(df, tr.constants_row(df))):
        assert len(plan_of(out)) < 20_000
        got = {r.id: np.array(r.features) for r in out.collect()}
        for i in range(3):
            assert np.allclose(got[i], (x[i] - mean) / std, atol=1e-9)


def numpy_local(x, y, worker, k, rounds, batch, lr=0.1, momentum=0.9):
    w = np.zeros((k, x.shape[1]))
    for r in range(rounds):
        total = np.zeros_like(w)
        for one in np.unique(worker):
            xs, ys = x[worker == one], y[worker == one]
            own, v = w.copy(), np.zeros_like(w)
            for a in range(0, len(ys), batch):
                xb, yb = xs[a:a + batch], ys[a:a + batch]
                s = xb @ own.T
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                v = momentum * v + (p - np.eye(k)[yb]).T @ xb / len(yb)
                own = own - tr.lr_at(r, lr) * v
            total += len(ys) * own
        w = total / len(y)
    return w


@pytest.mark.parametrize("parts, batch", [(1, 16), (5, 16), (5, 1000)])
def test_local_rounds_match_numpy(spark, parts, batch):
    import hashlib

    df = _train_frame(spark).repartition(parts)
    pdf = df.filter(F.col("split") == "train").toPandas().sort_values("vec_id")
    x, y = np.stack(pdf["features"].to_numpy()), pdf["label"].to_numpy()
    worker = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 3 for i in pdf["vec_id"]])
    k = int(df.agg(F.max("label")).first()[0]) + 1
    w, hist = tr.fit_local(df, "vec_id", 2, workers=3, batch_rows=batch)
    assert np.allclose(w, numpy_local(x, y, worker, k, 2, batch), atol=1e-10)
    assert len(hist) == 2 and hist[0]["loss"] <= math.log(k) + 0.1 and 0 <= hist[1]["val_accuracy"] <= 1


def test_local_rounds_of_nothing(spark):
    df = _train_frame(spark)
    w, hist = tr.fit_local(df.where("split = 'val'"), "vec_id", 2, workers=3, batch_rows=8)
    assert hist == [] and not w.any()


def test_halving_drops_the_worse_half(spark):
    df = _train_frame(spark)
    trials = sw.grid(lr=[0.01, 0.1, 1.0], momentum=[0.0, 0.9])
    full = {e: {r.trial_id: r for r in sw.sweep(df, trials, epochs=e).collect()} for e in (1, 2, 3)}
    got = {r.trial_id: r for r in sw.sweep(df, trials, epochs=3, halve=True).collect()}
    live = set(range(6))
    for steps in (1, 2):
        stay = sorted(live, key=lambda t: (round(full[steps][t].loss, 9), t))[:(len(live) + 1) // 2]
        for t in live - set(stay):
            assert got[t].epochs == steps and got[t].loss == pytest.approx(full[steps][t].loss)
        live = set(stay)
    for t in live:
        assert got[t].epochs == 3 and got[t].loss == pytest.approx(full[3][t].loss)


def test_vectors_in_ranges_of_slots_give_the_same_texts(spark):
    from emberline.operators import embed as em

    vecs = spark.createDataFrame([(i, [float(i), i * 0.5 + 1, -float(i)]) for i in range(7)], "slot long, embedding array<float>")
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, 3 * i))) for i in range(9)] + [(9, None)],
                                 "doc_id long, text string")
    want = em.embed(docs, vecs, 7)
    parts = em.embed(docs, vecs, 7, max_broadcast_rows=2)
    key = lambda r: (r.doc_id, r.dim)
    assert [(r.doc_id, r.dim, round(r.value, 9)) for r in sorted(parts.collect(), key=key)] == [
        (r.doc_id, r.dim, round(r.value, 9)) for r in sorted(want.collect(), key=key)]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan  # no vector is moved for a token


def test_a_worker_holds_the_vectors_once_in_their_own_precision(spark):
    import numpy as np
    import pandas as pd

    from emberline.operators import embed as em

    rows = [(i, [i / 7, -i / 3]) for i in range(50)]
    vecs = spark.createDataFrame(rows, "slot long, embedding array<float>").repartition(3)
    enc = em.MeanPoolEncoder(spark, vecs)
    matrix = enc.load()
    assert matrix.dtype == np.float32 and matrix.shape == (50, 2)
    got = enc.predict(pd.DataFrame({"slots": [[3, 4, 4], []]}))["embedding"]
    exact = np.asarray([rows[i][1] for i in (3, 4, 4)], dtype=np.float32).astype(np.float64).sum(axis=0) / 3
    assert got[0].tolist() == exact.tolist() and np.isnan(got[1]).all()
    bad = em.MeanPoolEncoder(spark, vecs.withColumn("slot", vecs.slot + 1))
    import pytest

    with pytest.raises(ValueError, match="slots"):
        bad.load()


def test_a_mini_batch_is_one_stage(spark, monkeypatch):
    """The partials of one step's rows are not shuffled, and add up as before."""
    import numpy as np

    from emberline.operators import training as tr

    rows = [(i, i % 3, [i / 10, 1.0 - i / 7]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, features array<double>").repartition(4)
    w = np.arange(6, dtype=float).reshape(1, 3, 2) / 5
    want = tr.pass_stats(df, w, split_col=None)
    sc = spark.sparkContext
    sc.setJobGroup("one-step", "one step")
    try:
        got = tr.pass_stats(df, w, split_col=None, one_step=True)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("one-step")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(got["grad"], want["grad"]) and got["n"] == want["n"]
    assert np.isclose(got["loss"][(0, "train")], want["loss"][(0, "train")])
    seen = []
    monkeypatch.setattr(tr, "pass_stats", lambda *a, **k: (seen.append(k.get("one_step", False)), want)[1])
    steps = df.withColumn("step_id", df.vec_id % 2)
    tr.fit_softmax(df, 1, steps=steps, n_classes=3)
    assert seen == [True, True] and jobs


def test_texts_meet_ranges_of_slots_without_a_shuffle(spark):
    """More vectors than one broadcast takes: no text, token or vector is shuffled or broadcast.
    Repeated ids are one text, null ids too; slots without a vector do not count."""
    rows = [(i, [float(i), i * 0.5 + 1]) for i in range(9) if i != 4]
    vecs = spark.createDataFrame(rows, "slot long, embedding array<float>")
    texts = [(i, " ".join(f"w{j}" for j in range(i, 3 * i))) for i in range(12)]
    texts += [(None, "w1 w2"), (None, "w3"), (5, "w5 w9"), (20, None), (21, " ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    once = docs.where("doc_id <> 5")
    plan = plan_of(em.embed(once, vecs, 9, max_broadcast_rows=3))
    assert "Join" not in plan and "Aggregate" not in plan
    for df in (docs, once, docs.limit(0)):
        want = {(r.doc_id, r.dim): r.value for r in em.embed(df, vecs, 9).collect()}
        got = em.embed(df, vecs, 9, max_broadcast_rows=3).collect()
        assert len(got) == len(want) and {(r.doc_id, r.dim) for r in got} == set(want)
        assert all(abs(want[r.doc_id, r.dim] - r.value) < 1e-9 for r in got)
    slots = em.token_slots(docs, 9, "doc_id").withColumn("pad", F.lit(7)).withColumn("slots", F.col("slots").cast("array<int>"))
    want = {(r.doc_id, r.dim): r.value for r in em.embed(docs.withColumn("pad", F.lit(7)), vecs, 9, pad_to="pad").collect()}
    for most in (3, 50_000):
        got = {(r.doc_id, r.dim): r.value for r in em.embed(slots, vecs, 9, pad_to="pad", max_broadcast_rows=most).collect()}
        assert got.keys() == want.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_sums_by_range_hold_few_tokens_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)).astype(np.float32)
    vecs = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "slot long, embedding array<float>")
    path = em._slot_ranges(vecs, 16)
    counts = rng.integers(0, 9, 200)
    slots = rng.integers(0, 50, counts.sum())
    monkeypatch.setattr(em, "GATHERED", 7)
    sums, n = em._sum_texts(path, 16, slots, counts)
    want = np.zeros((200, 4))
    np.add.at(want, np.repeat(np.arange(200), counts), x[slots].astype(float))
    assert np.allclose(sums, want, atol=1e-9) and (n == counts).all()


def test_padded_texts_do_not_pass_a_join(spark):
    from emberline.plans import catalog

    out = catalog.QUERIES["embed_pad_to_batch"](spark, SF_SMALL)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line and "doc_id#" in line)
    assert " AS slots#" in lines[join + 1]  # the side that had the texts

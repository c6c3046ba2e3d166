"""Vector search against brute force."""

import math

import numpy as np
import pytest

from conftest import SF_CHECK
from emberline.llm import neighbours


def brute(rows, query, k):
    q = next(v for i, v in rows if i == query)
    best = {}
    for i, v in rows:
        if i != query:
            s = sum(float(a) * float(b) for a, b in zip(q, v))
            best[i] = max(s, best.get(i, -math.inf))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_recall_on_sample_table(spark):
    table = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = {}
    for r in neighbours.op8_vector_search(spark, SF_CHECK).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i, _ in rows if i % 20 == 0]
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        want = brute(rows, q, 20)
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = dict(brute(rows, q, len(rows)))
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in found)
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(queries)


def test_recall_with_parts_to_choose_from(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 16)) * 0.6).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.search(table, lambda v: v % 100 == 0, k=10, probe_share=0.3, fit_sample=2000)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::100].astype(float) @ x.T.astype(float)
    s[np.arange(60), np.arange(0, 6000, 100)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(w.tolist()) & got[100 * k]) / 10 for k, w in enumerate(want)]) >= 0.9


def test_ties_invalid_rows_and_small_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 9.0]), (3, [0.5, -1.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]),
            (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (None, [9.0, 9.0]), (11, [9.0]), (1, [0.5, 0.5])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in neighbours.search(table, lambda v: v == 0, k=20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, 0.5)]
    assert neighbours.search(table.limit(0), lambda v: v == 0).count() == 0


def test_one_vector_in_most_rows(spark):
    rows = [(k, [1.0, 2.0] if k % 10 else [float(k), 1.0]) for k in range(5000)]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda v: v == 1, k=3)
    assert [(r["rank"], r["vec_id"]) for r in out.orderBy("rank").collect()] == [(1, 4990), (2, 4980), (3, 4970)]


def test_repeated_ids_do_not_push_out_others(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    near = [(61, (x[0] * (2 + m / 50)).tolist()) for m in range(30)]  # one id, many rows, all close to the query
    for loaded, parts in ((rows + rows, 1), (rows + near, 1), (rows + rows + near, None)):
        table = spark.createDataFrame(loaded, "vec_id long, embedding array<double>")
        got = neighbours.search(table, lambda v: v == 0, k=20, parts=parts).orderBy("rank").collect()
        assert [(r["vec_id"], r["rank"]) for r in got] == [(i, k + 1) for k, (i, _) in enumerate(brute(loaded, 0, 20))]


def test_blocks_of_one_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_BLOCK", 50)
    sizes = spark.sparkContext.accumulator(0)
    top = neighbours._block_top

    def watched(k):
        run = top(k)

        def seen(rows, queries):
            if rows.num_rows > 150:
                sizes.add(1)
            return run(rows, queries)
        return seen

    monkeypatch.setattr(neighbours, "_block_top", watched)
    rows = [(1, [1.0, k / 1000]) for k in range(1000)] + [(k, [0.5, float(k)]) for k in range(2, 40)]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v == 2, k=3, parts=1)
    assert [r["vec_id"] for r in out.orderBy("rank").collect()] == [39, 38, 37]
    assert sizes.value == 0

"""Sampling by interval joins = the predictor; text doubling on models that run together."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import generate as gen
from emberline.operators import sampling as smp
from emberline.operators import textmodel as tm

CORPUS = ["the cat sat on the mat . the dog sat on the log .", "a cat and a dog met on the mat and sat .",
          "on the log sat the dog . end", "lonely"]
PROMPTS = [(0, "where is the"), (1, "the cat"), (2, "   "), (3, "lonely"), (4, "zzz unknown"), (5, "dog sat on"),
           (5, "dog sat on"), (6, "the cat"), (6, "on the"), (7, None)]


@pytest.fixture(scope="module")
def counts(spark):
    return tm.fit_next_token(spark.createDataFrame([(t,) for t in CORPUS], "text string"))


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(PROMPTS, "prompt_id long, prompt string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def by_predictor(spark, prompts, counts, params):
    pred = gen.NextTokenPredictor(spark, tm.nucleus(counts, params.temperature, params.top_p), params)
    return rows(gen.long_form(gen.generate(prompts, pred)))


@pytest.mark.parametrize("params", [
    gen.SamplingParams(temperature=1.0, top_p=0.9, max_tokens=11, n=3),
    gen.SamplingParams(temperature=0.2, top_p=0.9, max_tokens=20),
    gen.SamplingParams(temperature=1.0, top_p=1.0, max_tokens=9, n=2, stop=("on the", ".")),
    gen.SamplingParams(temperature=0.7, top_p=0.5, max_tokens=8),
    gen.SamplingParams(temperature=1.0, top_p=0.9, max_tokens=0, n=2),
])
def test_joins_equal_the_predictor(spark, counts, prompts, params):
    placed = tm.nucleus(counts, params.temperature, params.top_p, placed=True)
    got = rows(smp.generate_sampled(prompts, placed, params))
    assert got == by_predictor(spark, prompts, counts, params)
    assert len(got) == len(PROMPTS) * params.n


def test_generate_text_has_no_model_bound(spark, counts, prompts):
    params = gen.SamplingParams(temperature=1.0, top_p=0.9, max_tokens=5, n=2)
    want = by_predictor(spark, prompts, counts, params)
    assert rows(gen.generate_text(prompts, counts, params, max_model_rows=0)) == want
    assert rows(gen.generate_text(prompts, counts, params)) == want


def test_nothing_to_sample(spark, counts, prompts):
    params = gen.SamplingParams(temperature=1.0, top_p=0.9, max_tokens=4)
    placed = tm.nucleus(counts, 1.0, 0.9, placed=True)
    assert rows(smp.generate_sampled(prompts.limit(0), placed, params)) == []
    assert {r[2:] for r in rows(smp.generate_sampled(prompts, placed.limit(0), params))} == {("", "stop", 0)}
    with pytest.raises(ValueError):
        smp.generate_sampled(prompts, placed, gen.SamplingParams())


@pytest.fixture(scope="module")
def hub(spark):
    """One context with 3,000 successors of few levels, others with one; all lead back."""
    pairs = [("hub", f"w{k}", 1 + k % 5) for k in range(3000)] + [(f"w{k}", "hub", 2) for k in range(3000)]
    return spark.createDataFrame(pairs, "ctx string, next_token string, cnt long")


@pytest.mark.parametrize("temperature, top_p", [(1.0, 0.9), (0.5, 0.77), (1.0, 1.0)])
def test_level_route_gives_the_same_places(hub, temperature, top_p):
    plain = rows(tm.nucleus(hub, temperature, top_p, placed=True))
    assert rows(tm.nucleus(hub, temperature, top_p, hot_successors=10, placed=True)) == plain
    assert rows(tm.nucleus(hub, temperature, top_p, hot_successors=10)) == sorted(r[:4] for r in plain)


def test_levels_are_ranked_in_parts_without_held_memory(spark, hub):
    """Levels of 600 tokens: parts of about 22 by prefix, below and above the bound."""
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    plain = rows(tm.nucleus(hub, 1.0, 0.77))
    for largest in (200, 21, 10):
        assert rows(tm.nucleus(hub, 1.0, 0.77, hot_successors=largest)) == plain
        if largest == 200:  # no large part: nothing is held
            assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_hot_context_by_shuffle_joins(spark, hub):
    """A third of all walks in one context: its candidates lie in thousands of
    buckets, and no broadcast of the model is planned."""
    params = gen.SamplingParams(temperature=1.0, top_p=0.9, max_tokens=6, n=2)
    prompts = spark.range(600).select(F.col("id").alias("prompt_id"), F.when(F.col("id") % 3 == 0, "hub").otherwise(
        F.concat(F.lit("w"), F.col("id").cast("string"))).alias("prompt"))
    placed = gen._stored(tm.nucleus(hub, 1.0, 0.9, hot_successors=10, placed=True), "nucleus")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(smp.generate_sampled(prompts, placed, params))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == by_predictor(spark, prompts, hub, params)


def test_buckets_hold_few_candidates_and_all_of_them(spark, hub):
    placed = gen._stored(tm.nucleus(hub, 1.0, 0.9, placed=True), "nucleus")
    contexts = smp._contexts(placed, spark.createDataFrame([("hub",)] * 5, "start string"))
    model = smp.interval_model(placed, contexts)
    hot = model.where("ctx = 'hub'")
    assert hot.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 6
    assert hot.select("next_token").distinct().count() == placed.where("ctx = 'hub'").count()
    assert model.count() < 4 * (placed.count() + contexts.agg(F.sum("buckets")).first()[0])
    assert spark.catalog.listTables() == [t for t in spark.catalog.listTables() if not t.name.startswith("emberline_")]


def greedy(argmax, token, params):
    out = []
    while len(out) < params.max_tokens and token in argmax:
        token = argmax[token]
        out.append(token)
    return " ".join(out), "length" if len(out) == params.max_tokens else "stop", len(out)


@pytest.mark.parametrize("max_tokens", [0, 1, 6, 7, 13, 200])
def test_doubling_where_all_tokens_lead_to_one(spark, max_tokens):
    """Every token leads to one hub, that to a chain that ends; a circle beside it."""
    table = {f"t{k}": "hub" for k in range(500)} | {"hub": "c0"} | {f"c{k}": f"c{k + 1}" for k in range(9)}
    table |= {"x": "y", "y": "z", "z": "x"}
    params = gen.SamplingParams(max_tokens=max_tokens)
    model = spark.createDataFrame(list(table.items()), "ctx string, next_token string")
    starts = [f"t{k}" for k in range(500)] + ["x", "c8", "c9", "none"]
    prompts = spark.createDataFrame(list(enumerate(starts)), "prompt_id long, prompt string")
    got = rows(gen.generate_joined(prompts, model, params))
    assert got == [(k, 0, *greedy(table, t, params)) for k, t in enumerate(starts)]


def test_tables_of_the_model_go_when_their_successors_are_written(spark, counts, prompts, tmp_dir):
    """Disk holds one form of the model at a time; given tables stay."""
    import os

    from emberline.session import ensure_checkpoint_dir, released

    def folder(df):
        return df.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[1]

    params = gen.SamplingParams(temperature=1.0, top_p=0.9, max_tokens=11, n=2)
    lazy = tm.nucleus(counts, 1.0, 0.9, hot_successors=3, placed=True)
    model = gen._stored(lazy, "nucleus")
    first = {path.rsplit("/", 1)[0].split(":", 1)[1] for path in lazy.inputFiles()}
    released(spark, lazy)
    assert first and not any(os.path.exists(f) for f in first)
    scratch = os.path.join("/" + ensure_checkpoint_dir(spark).split(":", 1)[-1].lstrip("/"), "scratch")
    before, own = set(os.listdir(scratch)), folder(model)
    want = rows(smp.generate_sampled(prompts, model, params))
    assert os.path.exists(own) and want == by_predictor(spark, prompts, counts, params)
    assert rows(smp.generate_sampled(prompts, model, params, own=True)) == want
    assert not os.path.exists(own)
    assert not [f for f in set(os.listdir(scratch)) - before if f.startswith("contexts")]
    counts.limit(3).write.parquet(tmp_dir + "/given")
    given = spark.read.parquet(tmp_dir + "/given")
    released(spark, given)
    assert given.count() == 3

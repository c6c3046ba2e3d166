"""Sinks (K1-K5) and the scoring stream (V1-V2): round trips, ordered
shards, run-keyed overwrite, batch = stream, bounded micro-batches."""

import glob
import json
import os

from pyspark.sql import functions as F

from emberline.operators import generate as gen
from emberline.operators import textmodel as tm
from emberline.sinks import writers as wr
from emberline.sources import prompts as src
from emberline.streaming import score as st


def test_ordered_shards_concatenate_in_order(spark, tmp_dir):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).alias("v")).repartition(5)
    path = os.path.join(tmp_dir, "ordered")
    wr.write_ordered(df, "k", path, 4)
    keys = []
    for f in sorted(glob.glob(os.path.join(path, "part-*"))):
        with open(f) as fh:
            keys += [json.loads(line)["k"] for line in fh]
    assert keys == list(range(1000))


def test_results_keep_nulls(spark, tmp_dir):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    path = wr.write_results(df, os.path.join(tmp_dir, "r"))
    lines = [ln for f in glob.glob(os.path.join(path, "part-*")) for ln in open(f) if ln.strip()]
    assert [json.loads(ln) for ln in lines] == [{"a": 1, "b": None}]


def test_run_partition_overwrite_is_per_run(spark, tmp_dir):
    path = os.path.join(tmp_dir, "runs")
    base = spark.range(3).select(F.col("id").alias("x"))
    wr.write_results(base, path, run_id="local")
    wr.write_results(base.limit(1), path, run_id="job-1")
    wr.write_results(base.limit(2), path, run_id="local")
    back = spark.read.json(path).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in back} == {"local": 2, "job-1": 1}


def test_write_run_folder(spark, tmp_dir):
    stats = spark.createDataFrame([(0, 2, 4, 1.0, 2.0)],
                                  "batch_id long, num_texts long, embedding_dim long, inference_time double, "
                                  "throughput double")
    from emberline.operators import metrics as mt
    path = wr.write_run(stats, os.path.join(tmp_dir, "run"), lambda s: mt.run_record(s, "m", {"k": 1}, 8, 2), config={"k": 1})
    assert spark.read.json(os.path.join(path, "report")).first().total_texts == 2
    assert spark.read.parquet(os.path.join(path, "batches")).count() == 1
    assert json.loads(spark.read.text(os.path.join(path, "config.json")).first().value) == {"k": 1}


def _predictor(spark):
    docs = spark.createDataFrame([("a b c a b d . a b c",)], "text string")
    am = tm.argmax_model(tm.fit_next_token(docs))
    return gen.NextTokenPredictor(spark, am, gen.SamplingParams(max_tokens=5, stop=(".",)))


def test_stream_equals_batch_and_bounds_work(spark, tmp_dir):
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "c a", "d", "zz", "a b"])],
                                    "prompt_id long, prompt string")
    in_dir = os.path.join(tmp_dir, "in")
    wr.write_ordered(prompts, "prompt_id", in_dir, 3)
    pred = _predictor(spark)
    q = st.score_stream(spark, in_dir, os.path.join(tmp_dir, "out"), pred, batch_size=2, max_files=1,
                        checkpoint_dir=os.path.join(tmp_dir, "ckpt"))
    streamed = sorted(tuple(r) for r in gen.long_form(st.read_scored(spark, os.path.join(tmp_dir, "out"))).collect())
    batch = sorted(tuple(r) for r in gen.long_form(gen.generate(prompts, pred, 2)).collect())
    assert streamed == batch
    n_files = len(glob.glob(os.path.join(in_dir, "part-*")))
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == n_files


def test_prompt_file_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    path = os.path.join(tmp_dir, "docs")
    wr.write_ordered(df, "doc_id", path, 3)
    got = sorted(tuple(r) for r in src.read_prompts(spark, path).collect())
    assert got == [(i, f"text {i}") for i in range(50)]


def test_prompt_tables_in_other_formats(spark, tmp_dir):
    from emberline.sources import files as fs

    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "d")], "id long, text string")
    for fmt in ("parquet", "json", "csv", "orc"):
        path = os.path.join(tmp_dir, fmt)
        w = df.write.mode("overwrite")
        w = w.option("header", True) if fmt == "csv" else w
        w.format(fmt).save(path)
        schema = "id long, text string" if fmt in ("csv", "json") else None
        got = sorted(tuple(r) for r in fs.prompts_from_table(fs.read_table(spark, path, fmt, schema), "id").collect())
        assert got == [(1, "a"), (4, "d")], fmt


def test_stream_restart_scores_only_new_files(spark, tmp_dir):
    pred = _predictor(spark)
    in_dir, out_dir, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    first = spark.createDataFrame([(0, "a"), (1, "b c")], "prompt_id long, prompt string")
    first.coalesce(1).write.mode("overwrite").json(in_dir)
    st.score_stream(spark, in_dir, out_dir, pred, checkpoint_dir=ckpt)
    assert st.read_scored(spark, out_dir).count() == 2
    later = spark.createDataFrame([(2, "a b"), (3, "d")], "prompt_id long, prompt string")
    later.coalesce(1).write.mode("append").json(in_dir)
    st.score_stream(spark, in_dir, out_dir, pred, checkpoint_dir=ckpt)
    ids = sorted(r.prompt_id for r in st.read_scored(spark, out_dir).collect())
    assert ids == [0, 1, 2, 3]


def test_metrics_of_a_stream_that_stops_and_goes_on(spark, tmp_dir):
    """State survives the restart; a micro-batch hands on what it changed."""
    from emberline.operators.metrics import outcome_rollup
    from emberline.streaming import metrics as sm

    pred = _predictor(spark)
    in_dir, out_dir, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "metrics", "ckpt"))
    schema = "prompt_id long, prompt string"
    files = [[(0, "a"), (1, "b c")], [(2, "zz"), (3, "d"), (4, None)], [(5, "a b")]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(in_dir)
        sm.metrics_stream(spark, in_dir, out_dir, pred, checkpoint_dir=ckpt)  # started anew for every file
        seen = spark.createDataFrame([r for f in files[:k + 1] for r in f], schema)
        want = sorted(tuple(r) for r in outcome_rollup(gen.long_form(gen.generate(seen, pred))).collect())
        assert sorted(tuple(r) for r in sm.read_rollup(spark, out_dir).collect()) == want
    progress = sm.read_progress(spark, out_dir)
    per = {r.epoch: r.n for r in progress.groupBy("epoch").agg(F.sum("completions").alias("n")).collect()}
    assert [per[e] for e in sorted(per)] == [len(f) for f in files]
    # a stream with nothing new changes nothing
    before = sm.read_updates(spark, out_dir).count()
    sm.metrics_stream(spark, in_dir, out_dir, pred, checkpoint_dir=ckpt)
    assert sm.read_updates(spark, out_dir).count() == before


def test_metrics_stream_takes_files_in_turn(spark, tmp_dir):
    from emberline.streaming import metrics as sm

    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "c a", "d", "zz", "a b"])], "prompt_id long, prompt string")
    in_dir, out_dir = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "metrics")
    wr.write_ordered(prompts, "prompt_id", in_dir, 3)
    sm.metrics_stream(spark, in_dir, out_dir, _predictor(spark), max_files=1, checkpoint_dir=os.path.join(tmp_dir, "ckpt"))
    n_files = len(glob.glob(os.path.join(in_dir, "part-*")))
    assert sm.read_updates(spark, out_dir).select("epoch").distinct().count() == n_files
    assert sm.read_progress(spark, out_dir).agg(F.sum("completions")).first()[0] == 6

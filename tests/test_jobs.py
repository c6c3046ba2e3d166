"""End-to-end jobs (J1-J4) on the small tables."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL, write_lines
from emberline.operators import generate as gen
from emberline.operators import textmodel as tm
from emberline.plans import jobs
from emberline.plans.tables import table


def test_batch_generation_job(spark, tmp_dir):
    lines = [json.dumps({"prompt": f"question {i} about the"}) for i in range(20)] + ["  ", '{"text": ""}']
    path = write_lines(os.path.join(tmp_dir, "in", "sample_prompts.jsonl"), lines)
    model = tm.argmax_model(tm.fit_next_token(table(spark, SF_SMALL, "documents")))
    pred = gen.NextTokenPredictor(spark, model, gen.SamplingParams(max_tokens=16, stop=(".",)))
    out = os.path.join(tmp_dir, "out")
    rep = jobs.batch_generation_job(spark, path, out, pred, batch_size=4, num_workers=2, max_prompts=20,
                                    config={"batch_size": 4})
    assert rep["total_prompts"] == 20 and rep["prompts_per_sec"] > 0
    res = spark.read.json(os.path.join(out, "results"))
    assert res.count() == 20
    assert set(res.columns) >= {"prompt_id", "prompt", "generated_text", "finish_reason", "num_tokens"}
    assert json.loads(spark.read.text(os.path.join(out, "config.json")).first().value) == {"batch_size": 4}


def test_embedding_and_training_jobs(spark, tmp_dir):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    rep = jobs.embedding_job(spark, docs, table(spark, SF_SMALL, "embeddings"), os.path.join(tmp_dir, "emb"),
                             batch_size=5, num_workers=2)
    assert rep["total_texts"] == docs.count()
    run = spark.read.json(os.path.join(tmp_dir, "emb", "run", "report")).first()
    assert run.total_texts == docs.count() and run.num_actors == 2
    feats = table(spark, SF_SMALL, "embeddings").withColumn(
        "features", F.transform("embedding", lambda v: v.cast("double")))
    out = jobs.training_job(spark, feats, os.path.join(tmp_dir, "train"), epochs=3, batch_rows=64, workers=2)
    assert out["epochs"] == 3 and 0 <= out["val_accuracy"] <= 1
    smoke = jobs.training_job(spark, feats, os.path.join(tmp_dir, "smoke"), epochs=3, smoke=True)
    assert smoke["epochs"] == 1

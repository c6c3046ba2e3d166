"""End-to-end jobs: the three entry points of the original toolkit as Spark
jobs. Each reads its input, guards against an empty load, runs on the
executors and writes its results plus a run folder (config copy, one-row
report). Wall-clock figures are measured on the driver around the single
write action; counts come from an ``Observation`` on that same action.
"""

from __future__ import annotations

import json
import os
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batching as bt
from ..operators import embed as em
from ..operators import generate as gen
from ..operators import metrics as mt
from ..operators import prompts as pr
from ..operators import training as tr
from ..session import prepare
from ..sinks import writers as wr
from ..sources import prompts as src


def _write_report(spark: SparkSession, out_dir: str, report: dict, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(out_dir, "config.json"))
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "report string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(out_dir, "report.json"))


def batch_generation_job(spark: SparkSession, input_path: str, out_dir: str, predictor,
                         batch_size: int = 8, num_workers: int | None = None, max_prompts: int | None = None,
                         limit_raw: bool = False, run_id: str | None = None, config: dict | None = None) -> dict:
    """Prompt JSONL -> results JSONL (+ ``prompt_id``) and a report
    with prompts/s = prompts / elapsed (clock around the scoring write).
    ``limit_raw`` takes the first K records before the prompt choice (J1);
    the default counts usable prompts (J2)."""
    prepare(spark)
    if limit_raw:
        recs = pr.limit_raw(src.read_prompt_records(spark, input_path), max_prompts)
        prompts = pr.drop_empty(pr.choose_prompt(recs))
    else:
        prompts = src.read_prompts(spark, input_path, max_prompts=max_prompts)
    src.require_rows(prompts)
    prompts, obs = src.observe_count(prompts)
    results = gen.generate(prompts, predictor, batch_size, num_workers)
    results_dir = os.path.join(out_dir, "results")
    t0 = time.perf_counter()
    wr.write_results(results, results_dir, run_id=run_id)
    elapsed = time.perf_counter() - t0
    n = int(obs.get["n_prompts"])
    report = {"timestamp": datetime.now(timezone.utc).isoformat(), "total_prompts": n,
              "elapsed_sec": elapsed, "prompts_per_sec": n / elapsed if elapsed > 0 else None,
              "batch_size": batch_size, "num_workers": num_workers}
    _write_report(spark, out_dir, report, config or {})
    return report


def embedding_job(spark: SparkSession, docs: DataFrame, vectors: DataFrame, out_dir: str, batch_size: int = 8,
                  num_workers: int = 2, id_col: str = "doc_id", text_col: str = "text", model: str = "mean-pool",
                  config: dict | None = None) -> dict:
    """Encode texts (first 128 tokens, mean pool) in batches, keep the
    vectors and per-batch statistics, and write the run report (overall and
    mean batch throughput, both definitions)."""
    prepare(spark)
    vecs = em.vector_slots(vectors)
    encoder = em.MeanPoolEncoder(spark, vecs)
    slots = em.token_slots(docs, encoder.n_vectors, id_col, text_col)
    batched = bt.assign_workers(bt.assign_batches(slots, id_col, batch_size, keys=docs.select(id_col)), num_workers)
    encoded = em.encode(batched, encoder, id_col=id_col, keep=("batch_id", "worker_id"),
                        batch_size=batch_size, batch_col="batch_id", time_col="inference_time")
    encoded, obs = src.observe_count(encoded, "texts")
    t0 = time.perf_counter()
    wr.write_parquet(encoded, os.path.join(out_dir, "embeddings"))
    elapsed = time.perf_counter() - t0
    n = int(obs.get["n_prompts"])
    # batch times are those measured around the encoder calls
    stats = em.batch_stats(spark.read.parquet(os.path.join(out_dir, "embeddings")))
    wr.write_run(stats, os.path.join(out_dir, "run"),
                 lambda stored: mt.run_record(stored, model, config or {}, batch_size, num_workers), config=config or {})
    report = {"total_texts": n, "total_time": elapsed, "overall_throughput": n / elapsed if elapsed > 0 else None}
    _write_report(spark, out_dir, report, config or {})
    return report


def training_job(spark: SparkSession, features: DataFrame, out_dir: str, epochs: int, key: str = "vec_id",
                 val_pct: int = 20, batch_rows: int | None = None, workers: int = 1, smoke: bool = False,
                 **fit_kw) -> dict:
    """Split, (optionally) mini-batch steps of ``batch_rows * workers``,
    momentum SGD with the stepped rate, per-epoch validation; writes the
    epoch history and the weights. ``smoke`` runs one step."""
    prepare(spark)
    df = tr.split(features, key, val_pct)
    steps = tr.step_table(df, key, batch_rows, workers) if batch_rows else None
    w, hist = tr.fit_softmax(df, epochs, steps=steps, max_steps=1 if smoke else None, **fit_kw)
    wr.write_parquet(tr.history_frame(spark, hist), os.path.join(out_dir, "history"))
    wr.write_parquet(tr.weights_frame(spark, w), os.path.join(out_dir, "weights"))
    final = hist[-1] if hist else {}
    return {"epochs": len(hist), "val_accuracy": final.get("val_accuracy"), "loss": final.get("loss")}

"""Run metrics (A1-A4) and the run record (K5)."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_totals(stats: DataFrame, elapsed: float | None = None) -> DataFrame:
    """A1 + A2 in one row: texts, batches, time, overall throughput
    (texts / elapsed; elapsed defaults to the summed batch time) and the
    unweighted mean of per-batch throughput. The two differ; both are kept."""
    total_time = F.sum("inference_time")
    wall = F.lit(float(elapsed)) if elapsed is not None else total_time
    return stats.agg(
        F.sum("num_texts").cast("long").alias("total_texts"),
        F.count(F.lit(1)).alias("num_batches"),
        total_time.alias("total_time"),
        F.when(wall > 0, F.sum("num_texts") / wall).alias("overall_throughput"),
        F.avg("throughput").alias("avg_batch_throughput"),
    )


def outcome_rollup(results_long: DataFrame) -> DataFrame:
    """A3: completions, token total and longest completion per finish reason."""
    return results_long.groupBy("finish_reason").agg(
        F.count(F.lit(1)).alias("completions"),
        F.sum("num_tokens").cast("long").alias("total_tokens"),
        F.max("num_tokens").cast("long").alias("max_tokens"),
    )


def run_record(stats: DataFrame, model: str, params: dict, batch_size: int, num_workers: int,
               timestamp: str | None = None) -> DataFrame:
    """K5: the one-row run report: model, time, sizes and the totals of A1/A2.
    One aggregate pass over the batch table, which ``sinks.write_run`` keeps
    whole next to the report."""
    ts = timestamp or datetime.now(timezone.utc).isoformat()
    total_time = F.sum("inference_time")
    return stats.agg(
        F.lit(model).alias("model"),
        F.lit(ts).alias("timestamp"),
        F.lit(num_workers).cast("long").alias("num_actors"),
        F.count(F.lit(1)).alias("num_batches"),
        F.lit(batch_size).cast("long").alias("batch_size"),
        F.sum("num_texts").cast("long").alias("total_texts"),
        total_time.alias("total_time"),
        F.when(total_time > 0, F.sum("num_texts") / total_time).alias("overall_throughput"),
        F.avg("throughput").alias("avg_batch_throughput"),
        F.max("embedding_dim").alias("embedding_dim"),
        F.lit(json.dumps(params, sort_keys=True)).alias("params"),
    )

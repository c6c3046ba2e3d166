"""Metrics of a running scoring stream (V1 + A3).

The scored rows of a stream are rolled up by finish reason in a stateful
aggregate: completions, tokens and the longest completion so far, kept in the
state store across micro-batches and, through the checkpoint, across restarts.
In update mode a micro-batch hands on only the reasons it changed; they are
written to a folder of their own (its number is in the path, so a replayed
micro-batch replaces what it wrote before). The newest row of each reason is the
rollup of everything scored; the differences between a reason's rows are what
each micro-batch did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.generate import generate, long_form
from ..operators.metrics import outcome_rollup
from ..session import scratch_path
from .score import read_prompt_stream

# One folder a micro-batch: its number, then the rows that changed in it.
BATCH = "epoch"
ROLLUP = "finish_reason string, completions long, total_tokens long, max_tokens long"


def metrics_stream(spark: SparkSession, in_dir: str, metrics_dir: str, predictor, batch_size: int = 8,
                   max_files: int | None = None, checkpoint_dir: str | None = None, available_now: bool = True):
    """Start the rolled-up scoring stream over the prompt files of ``in_dir``;
    with ``available_now`` it takes what is there and stops. Start it again with
    the same ``checkpoint_dir`` to go on from its state. Returns the query."""
    scored = generate(read_prompt_stream(spark, in_dir, max_files), predictor, batch_size)
    rollup = outcome_rollup(long_form(scored))

    def keep(changed: DataFrame, epoch: int) -> None:
        changed.coalesce(1).write.mode("overwrite").parquet(f"{metrics_dir.rstrip('/')}/{BATCH}={epoch}")

    writer = rollup.writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", checkpoint_dir or scratch_path(spark, "metrics-ckpt"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def read_updates(spark: SparkSession, metrics_dir: str) -> DataFrame:
    """Every row the stream handed on: ``(epoch, finish_reason, completions,
    total_tokens, max_tokens)``, running values."""
    return spark.read.schema(ROLLUP + f", {BATCH} long").parquet(metrics_dir)


def read_rollup(spark: SparkSession, metrics_dir: str) -> DataFrame:
    """The state by now: A3's table over all rows scored so far."""
    names = ["completions", "total_tokens", "max_tokens"]
    last = F.max_by(F.struct(*names), BATCH).alias("s")
    return read_updates(spark, metrics_dir).groupBy("finish_reason").agg(last).select("finish_reason", "s.*")


def read_progress(spark: SparkSession, metrics_dir: str) -> DataFrame:
    """What each micro-batch added: ``(epoch, finish_reason, completions,
    tokens)``. One window per reason over the micro-batches that changed it."""
    w = Window.partitionBy("finish_reason").orderBy(BATCH)
    return read_updates(spark, metrics_dir).select(
        BATCH, "finish_reason",
        (F.col("completions") - F.coalesce(F.lag("completions").over(w), F.lit(0))).alias("completions"),
        (F.col("total_tokens") - F.coalesce(F.lag("total_tokens").over(w), F.lit(0))).alias("tokens"))

"""Score prompts as they arrive (V1, V2).

Re-aimed from a request/response endpoint: prompt files land in a folder, a
Structured Streaming query reads them with a fixed schema, runs the same
stateless predictor harness as the batch job and writes Parquet with a
checkpoint in the shared folder (exactly-once file sink). ``max_files`` bounds
the work taken per micro-batch, the streaming form of "at most 2 x workers
batches in flight".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.generate import generate
from ..session import scratch_path

STREAM_PROMPT_SCHEMA = T.StructType([
    T.StructField("prompt_id", T.LongType()),
    T.StructField("prompt", T.StringType()),
])


def read_prompt_stream(spark: SparkSession, in_dir: str, max_files: int | None = None,
                       schema: T.StructType = STREAM_PROMPT_SCHEMA) -> DataFrame:
    """Prompt files as a stream, at most ``max_files`` of them a micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(in_dir).select("prompt_id", "prompt")


def score_stream(spark: SparkSession, in_dir: str, out_dir: str, predictor, batch_size: int = 8,
                 max_files: int | None = None, checkpoint_dir: str | None = None,
                 schema: T.StructType = STREAM_PROMPT_SCHEMA, available_now: bool = True):
    """Start the scoring stream; with ``available_now`` it processes what is
    there (in ``max_files`` slices) and stops. Returns the finished query."""
    scored = generate(read_prompt_stream(spark, in_dir, max_files, schema), predictor, batch_size)
    ckpt = checkpoint_dir or scratch_path(spark, "stream-ckpt")
    writer = scored.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start(out_dir)
    if available_now:
        q.awaitTermination()
    return q


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    """The sink's committed rows as a batch table."""
    return spark.read.parquet(out_dir)

"""Sinks (K1-K5): sharded JSONL, ordered shards, Parquet, run-keyed output
and the run record."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: run id used when no scheduler job id is known.
LOCAL_RUN = "local"


def write_results(df: DataFrame, path: str, run_id: str | None = None, mode: str = "overwrite") -> str:
    """K1 (+K4): sharded JSONL, null fields written out. With ``run_id`` the
    rows go under ``run_id=<id>/`` and only that run's folder is replaced
    (dynamic partition overwrite), so reruns never touch other runs."""
    writer = df.write.option("ignoreNullFields", "false")
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id or LOCAL_RUN))
        writer = (df.write.option("ignoreNullFields", "false").option("partitionOverwriteMode", "dynamic")
                  .partitionBy("run_id"))
    writer.mode(mode).json(path)
    return path


def write_ordered(df: DataFrame, key: str, path: str, num_shards: int | None = None) -> str:
    """K2: shards whose concatenation in file-name order is sorted by ``key``:
    range partitioning puts key ranges in partition order, each shard is sorted
    inside. Without ``num_shards`` their number follows the data (adaptive
    execution joins small ranges). Merging into one file is left to the caller
    (single machine)."""
    ranged = df.repartitionByRange(num_shards, key) if num_shards else df.repartitionByRange(key)
    (ranged.sortWithinPartitions(key)
       .write.mode("overwrite").option("ignoreNullFields", "false").json(path))
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header; quotes inside values are doubled, as ``sources.files.read_csv``
    expects, and times keep their microseconds."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    (df.write.mode(mode).option("header", True).option("escape", '"').option("timestampNTZFormat", micros)
       .option("timestampFormat", micros + "XXX").csv(path))
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """K3: Parquet (optionally partitioned)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_run(stats: DataFrame, path: str, record, config: dict | None = None) -> str:
    """K5: the run folder: ``config.json`` (a copy of the job settings),
    ``batches/`` (the full batch table) and ``report/`` (the one-row record).
    ``record`` makes the report from the batch table; it is given the stored
    one, so the run itself is computed once."""
    spark = stats.sparkSession
    stats.write.mode("overwrite").parquet(os.path.join(path, "batches"))
    stored = spark.read.parquet(os.path.join(path, "batches"))
    record(stored).coalesce(1).write.mode("overwrite").json(os.path.join(path, "report"))
    if config is not None:
        spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string") \
            .coalesce(1).write.mode("overwrite").text(os.path.join(path, "config.json"))
    return path

"""Batches and their placement (B1-B4) and the vectorised batch map."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .indexing import dense_index


def assign_batches(df: DataFrame, key: str, size: int, index_col: str = "row_idx",
                   batch_col: str = "batch_id", keys: DataFrame | None = None) -> DataFrame:
    """B1: row i (0-based in ``key`` order) goes to batch ``i // size``; only
    the last batch is short. The index comes from :func:`dense_index`, so no
    step moves the table into one partition.

    ``keys``, the key column alone from a plain scan of the same table, keeps
    wide rows out of the index: only keys are sorted and checkpointed (not
    shuffled if the files are in key order), and ``df`` is joined to them, so
    keys must be unique and not null. Without it, ``df`` is indexed whole."""
    if size < 1:
        raise ValueError("batch size must be >= 1")
    if keys is None:
        idx = dense_index(df, [key], index_col)
    else:
        idx = dense_index(keys.select(key), [key], index_col, maybe_sorted=True)
        idx = idx if df.columns == [key] else df.join(idx, key)
    return idx.withColumn(batch_col, F.floor(F.col(index_col) / F.lit(size)).cast("long"))


def batch_profile(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """B2: rows per batch (the "N prompts -> M batches" line, per batch)."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("batch_rows"))


def batch_summary(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """B2 totals: prompts, batches, smallest and largest batch in one row."""
    per = batch_profile(df, batch_col)
    return per.agg(
        F.sum("batch_rows").cast("long").alias("n_prompts"),
        F.count(F.lit(1)).alias("n_batches"),
        F.min("batch_rows").alias("min_batch"),
        F.max("batch_rows").alias("max_batch"),
    )


def assign_workers(df: DataFrame, workers: int, batch_col: str = "batch_id", worker_col: str = "worker_id",
                   place: bool = False) -> DataFrame:
    """Batch i -> worker ``i % W``. The column is the contract; with
    ``place=True`` rows are also hash-partitioned into ``W`` partitions by it."""
    out = df.withColumn(worker_col, F.pmod(F.col(batch_col), F.lit(workers)).cast("long"))
    if place:
        out = out.repartition(workers, worker_col)
    return out


def placement_report(df: DataFrame, worker_col: str = "worker_id", batch_col: str = "batch_id") -> DataFrame:
    """How work spread over workers: rows and distinct batches per
    worker, number of distinct workers, and skew = max rows / mean rows."""
    per = df.groupBy(worker_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(batch_col).alias("batches"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_workers"),
        F.sum("rows").cast("long").alias("total_rows"),
        F.sum("batches").cast("long").alias("total_batches"),
        F.max("rows").alias("max_rows"),
        F.min("rows").alias("min_rows"),
        F.round(F.max("rows") / F.avg("rows"), 6).alias("skew"),
    )


def task_placement(df: DataFrame) -> DataFrame:
    """B4 as run: rows per physical Spark partition (``spark_partition_id``)."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("rows"))


def _rebatch_by_count(fn: Callable[[pd.DataFrame], pd.DataFrame], size: int):
    def run(it):
        pending: list[pd.DataFrame] = []
        held = 0
        for pdf in it:
            start = 0
            while start < len(pdf):
                take = min(size - held, len(pdf) - start)
                pending.append(pdf.iloc[start:start + take])
                held += take
                start += take
                if held == size:
                    yield fn(pd.concat(pending, ignore_index=True))
                    pending, held = [], 0
        if held:
            yield fn(pd.concat(pending, ignore_index=True))
    return run


def _rebatch_by_key(fn: Callable[[pd.DataFrame], pd.DataFrame], batch_col: str):
    def run(it):
        pending: list[pd.DataFrame] = []
        current = None
        for pdf in it:
            if pdf.empty:
                continue
            ids = pdf[batch_col].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                bid = ids[a]
                if current is not None and bid != current:
                    yield fn(pd.concat(pending, ignore_index=True))
                    pending = []
                current = bid
                pending.append(pdf.iloc[a:b])
        if pending:
            yield fn(pd.concat(pending, ignore_index=True))
    return run


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, batch_size: int,
                batch_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Call ``fn`` on pandas batches of at most ``batch_size`` rows.

    Without ``batch_col`` the Arrow stream of each partition is re-cut into
    exact batches (full except one tail per partition). With ``batch_col``
    (from :func:`assign_batches`) every batch is exactly the global batch: rows
    are range-partitioned by the batch id, so a batch never straddles two
    tasks. Select and filter *before* calling this: the Python step is a
    barrier to column pruning and filter push-down."""
    prepare(df.sparkSession)
    if batch_col is None:
        return df.mapInPandas(_rebatch_by_count(fn, batch_size), schema)
    n = num_partitions or df.sparkSession.sparkContext.defaultParallelism
    staged = df.repartitionByRange(n, batch_col).sortWithinPartitions(batch_col)
    return staged.mapInPandas(_rebatch_by_key(fn, batch_col), schema)

"""Dense positions without single-partition windows.

``rank_within`` gives every row its 0-based position inside its group under
a total order, and works when one group holds most of the table (the global
index of B1 is the extreme case: a single group). The plan is

1. range-partition and sort by (group, order): a hot group is cut across
   many partitions by the range partitioner instead of landing in one task;
2. record each row's partition id and local offset (JVM expressions);
3. checkpoint to the shared folder, so both passes below see the same rows
   even after an executor loss;
4. per-partition row counts (one row per partition) -> running offsets;
5. per-group start = ``min`` of the global position (partial aggregate,
   so a hot group costs no more than any other);
6. rank = global position - group start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, join_small, shuffle_partitions


def _as_cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _numbered(sorted_parts: DataFrame) -> DataFrame:
    """Adds ``_lpos``, row numbers that run on inside a unit ``_pid``, stored so
    that both passes see the same rows."""
    return checkpoint(sorted_parts.withColumn("_lpos", F.monotonically_increasing_id()))


def _file_splits(df: DataFrame) -> Column | None:
    """The file split a row was read from, for a scan of files."""
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    try:
        df.select(split)
    except AnalysisException:
        return None
    return split


def _in_place(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame] | None:
    """Numbered rows and per-split facts of a scan whose file splits, each
    sorted where it is, follow each other without overlap (a table written in
    key order, however its splits are packed into tasks); None for any other
    table."""
    split = _file_splits(df)
    if split is None:
        return None
    staged = _numbered(df.withColumn("_pid", split).sortWithinPartitions("_pid", *order))
    key = F.struct(*order)
    parts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_lpos").alias("_lpos0"),
                                       F.min(key).alias("_first"), F.max(key).alias("_last"))
    before = F.lag("_last").over(Window.orderBy("_first", "_pid"))  # one row per split
    if parts.withColumn("_before", before).where(F.col("_before") >= F.col("_first")).isEmpty():
        return staged, parts
    return None


def global_positions(df: DataFrame, order: Sequence[Column | str], name: str = "_gpos",
                     num_partitions: int | None = None, maybe_sorted: bool = False) -> DataFrame:
    """Add ``name`` = 0-based position of the row in ``order`` (ties must not
    occur: include a unique key). Adds helper column ``_pid``. With
    ``maybe_sorted`` (a scan of files, ascending column names) the files' splits
    are first tried as they are; a table in key order then needs no shuffle."""
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    keys = _as_cols(order)
    found = _in_place(df, order) if maybe_sorted else None
    if found is None:
        staged = _numbered(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()))
        parts, by = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_lpos").alias("_lpos0")), "_pid"
    else:
        (staged, parts), by = found, "_first"
    # One row per partition or file split: the ordered window and the broadcast
    # below (if it is proven small) are over a few thousand rows, as a rule.
    offsets = parts.select(
        "_pid",
        (F.coalesce(F.sum("_n").over(Window.orderBy(by, "_pid").rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0)) - F.col("_lpos0")).alias("_off"),
    )
    return (join_small(staged, offsets, "_pid")
            .withColumn(name, F.col("_off") + F.col("_lpos"))
            .drop("_off", "_lpos"))


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank",
                num_partitions: int | None = None, max_broadcast_groups: int = 200_000,
                maybe_sorted: bool = False) -> DataFrame:
    """Add ``name`` = 0-based rank of the row within ``group`` under ``order``.

    ``order`` must be total inside a group. The group-start table has one row
    per group; it is broadcast only when its size is proven small."""
    keys = [F.col(g) for g in group] + _as_cols(order)
    pos = global_positions(df, order if maybe_sorted and not group else keys, "_gpos", num_partitions,
                           maybe_sorted and not group)
    if not group:
        return pos.withColumnRenamed("_gpos", name).drop("_pid")
    # one row per group; kept so the size check and the join read it once
    starts = pos.groupBy(*group).agg(F.min("_gpos").alias("_gstart")).persist(StorageLevel.MEMORY_AND_DISK)
    ranked = join_small(pos, starts, list(group), max_rows=max_broadcast_groups)
    return ranked.withColumn(name, F.col("_gpos") - F.col("_gstart")).drop("_gpos", "_gstart", "_pid")


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_idx",
                num_partitions: int | None = None, maybe_sorted: bool = False) -> DataFrame:
    """Global 0-based row index in ``order`` (a unique key), the distributed
    equivalent of ``row_number() over (order by key) - 1``. ``maybe_sorted``:
    see :func:`global_positions`."""
    return rank_within(df, [], order, name, num_partitions, maybe_sorted=maybe_sorted)

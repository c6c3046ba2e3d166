"""Text embedding (E1-E4): truncation, mean pooling, predictor-based encode
and per-batch statistics.

Token vectors come from a vector table ``(slot, embedding)``: a token's slot
is ``md5(token) mod n_vectors``. Pooling is a masked mean by default (padding
does not count); ``pad_to`` divides by the batch's padded length instead, as
an unmasked mean over zero-padded rows would.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow.fs import FileType
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from ..functions.hashing import md5_bucket
from ..functions.text import tokens
from ..session import (
    _arrow_fs, has_at_most, prepare, read_model_batches, scratch_path, shuffle_partitions, write_model_table)
from .batching import _rebatch_by_count, _rebatch_by_key
from .generate import cached_state
from .indexing import dense_index

# Fixed value: tokens kept per text by the encoder.
MAX_TOKENS = 128
# Ranges of slots that a table of vectors may be cut into; a task reads one after the other.
BLOCKS = 128
# Tokens and texts a task holds while it reads the ranges, and tokens whose vectors it holds at once.
HELD_TOKENS, HELD_TEXTS, GATHERED = 1 << 22, 1 << 15, 1 << 16


def truncate_tokens(df: DataFrame, text_col: str = "text", max_len: int = MAX_TOKENS) -> DataFrame:
    """First ``max_len`` tokens of each text (``truncated`` flags cuts)."""
    t = tokens(text_col)
    return (df.withColumn("tokens", F.slice(t, 1, max_len))
              .withColumn("truncated", F.size(t) > F.lit(max_len)))


def vector_slots(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(slot, embedding)``: slot = 0-based rank of the vector id."""
    return dense_index(vectors.select(id_col, vec_col), [id_col], "slot").select(
        F.col("slot").cast("long").alias("slot"), F.col(vec_col).alias("embedding"))


def token_slots(df: DataFrame, n_vectors: int, id_col: str, text_col: str = "text",
                max_len: int = MAX_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, slots array<long>)``: each kept token's vector slot, in the JVM."""
    t = F.slice(tokens(text_col), 1, max_len)
    return df.select(id_col, *keep, F.transform(t, lambda x: md5_bucket(n_vectors, x)).alias("slots"))


def vector_column(vec_col: str):
    """An ``array`` column as a JVM vector, for vector aggregates."""
    return array_to_vector(F.transform(F.col(vec_col), lambda x: x.cast("double")))


def _slot_ranges(vectors: DataFrame, size: int) -> str:
    """The vectors in the shared folder, one subfolder for each ``size`` slots."""
    path = scratch_path(vectors.sparkSession, "vector-ranges")
    block = F.floor(F.col("slot") / F.lit(size)).cast("long").alias("block")
    vectors.where("slot is not null").select("slot", "embedding", block).repartition("block").write.partitionBy("block").parquet(path)
    return path


def _read_range(path: str, block: int, size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Inside a Python worker: the vectors of a range's slots (of a slot with several, their
    sum), in the table's own precision, and how many each slot has; None if it has none."""
    folder = f"{path}/block={block}"
    fs, where = _arrow_fs(folder)
    if fs.get_file_info(where).type == FileType.NotFound:
        return None
    matrix, times = None, np.zeros(size, np.int64)
    for batch in read_model_batches(folder, ["slot", "embedding"]):
        if not batch.num_rows:
            continue
        at = batch.column("slot").to_numpy(zero_copy_only=False) - block * size
        vector = batch.column("embedding")
        dim = set(pa.compute.list_value_length(vector).unique().to_pylist())
        if len(dim) != 1 or (matrix is not None and dim != {matrix.shape[1]}) or vector.flatten().null_count:
            raise ValueError("vectors must be whole and of one length")
        values = vector.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if matrix is None:
            matrix = np.zeros((size, values.shape[1]), values.dtype)
        met = np.bincount(at, minlength=size)
        if ((times + met) > 1).any():
            matrix = matrix.astype(np.float64)
            np.add.at(matrix, at, values)
        else:
            matrix[at] = values
        times += met
    return None if matrix is None else (matrix, times)


def _sum_texts(path: str, size: int, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Sums of the vectors of each text's slots, range after range, and how many vectors they are."""
    text = np.repeat(np.arange(len(counts)), counts)
    block = slots // size
    order = np.argsort(block.astype(np.int16) if len(block) and block.max() < 1 << 15 else block, kind="stable")
    some, first = np.unique(block[order], return_index=True)
    sums, n = None, np.zeros(len(counts), np.int64)
    for b, lo, hi in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        found = _read_range(path, b, size)
        if found is None:
            continue
        matrix, times = found
        if sums is None:
            sums = np.zeros((len(counts), matrix.shape[1]))
        elif sums.shape[1] != matrix.shape[1]:
            raise ValueError("vectors must be whole and of one length")
        for at in range(lo, hi, GATHERED):  # in the texts' order: a text is one run
            mine = order[at:min(at + GATHERED, hi)]
            where, owner = slots[mine] - b * size, text[mine]
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sums[owner[starts]] += np.add.reduceat(matrix[where].astype(np.float64), starts, axis=0)
            n[owner[starts]] += np.add.reduceat(times[where], starts)
    return sums, n


def _pooled_by_range(rows: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """``(keys, mean array, n)`` of each row ``(keys, slots)`` that meets a vector. Neither
    texts nor vectors are shuffled: a task holds texts of HELD_TOKENS tokens and reads
    the ranges of slots from the shared folder, one at a time."""
    prepare(rows.sparkSession)
    path = _slot_ranges(vectors, size)
    schema = StructType([f for f in rows.schema.fields if f.name != "slots"]).add("mean", ArrayType(DoubleType())).add("n", LongType())
    out_schema = to_arrow_schema(schema)
    keys = [f.name for f in schema.fields[:-2]]
    place = rows.columns.index("slots")

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [b.column(place) for b in held]
        counts = np.concatenate([pa.compute.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False) for x in lists])
        slots = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        sums, n = _sum_texts(path, size, slots, counts.astype(np.int64))
        if sums is None:
            return
        first = 0
        for batch in held:
            last = first + batch.num_rows
            own = np.flatnonzero(n[first:last])
            for lo in range(0, len(own), 2048):
                mine = own[lo:lo + 2048]
                mean = sums[first + mine] / n[first + mine][:, None]
                lists = pa.ListArray.from_arrays(np.arange(len(mine) + 1, dtype=np.int32) * mean.shape[1], pa.array(mean.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(k)).take(pa.array(mine)).cast(out_schema.field(k).type) for k in keys),
                     lists.cast(out_schema.field("mean").type), pa.array(n[first + mine])], schema=out_schema)
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, count = [], 0, 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                held.append(batch)
                texts += batch.num_rows
                count += pa.compute.sum(pa.compute.list_value_length(batch.column(place))).as_py() or 0
                if count >= HELD_TOKENS or texts >= HELD_TEXTS:
                    yield from flush(held)
                    held, texts, count = [], 0, 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, schema)


def pooled_vectors(df: DataFrame, vectors: DataFrame, n_vectors: int, id_col: str = "doc_id", text_col: str = "text",
                   max_len: int = MAX_TOKENS, keep: tuple[str, ...] = (), max_broadcast_rows: int = 50_000) -> DataFrame:
    """``(id, *keep, mean vector, n)`` per text with tokens, ``n`` its kept tokens.

    A table that has ``slots`` (:func:`token_slots`) needs no text. While the table of
    vectors is proven small it is broadcast: tokens (at most ``max_len``) are hashed to
    slots and counted, these meet the vectors, whole, and one weighted vector
    aggregate per text sums them up: no row is multiplied by the dimension. A larger
    one is cut into ranges of that many slots in the shared folder, which the tasks
    that hold the texts read one after the other; rows that repeat an id are added up
    after that. Beyond BLOCKS ranges, a shuffle join moves a vector for each row."""
    keys = [id_col, *keep]
    small = has_at_most(vectors, max_broadcast_rows)
    if not small and has_at_most(vectors, BLOCKS * max_broadcast_rows):
        rows = df.select(*keys, "slots") if "slots" in df.columns else token_slots(df, n_vectors, id_col, text_col, max_len, keep)
        pooled = _pooled_by_range(rows, vectors, max_broadcast_rows).withColumn("mean", array_to_vector("mean"))
        again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
        if again.isEmpty():
            return pooled
        return pooled.groupBy(*keys).agg(Summarizer.mean(F.col("mean"), F.col("n")).alias("mean"), F.sum("n").alias("n"))
    # outer: a plain explode would have the tokens made twice, once to see that there are any
    if "slots" in df.columns:
        toks = df.select(*keys, F.explode_outer("slots").alias("slot")).where("slot is not null").select(
            *keys, F.col("slot").cast("long").alias("slot"))
        slot = F.col("slot")
    else:
        toks = df.select(*keys, F.explode_outer(F.slice(tokens(text_col), 1, max_len)).alias("_t")).where("_t is not null")
        slot = md5_bucket(n_vectors, F.col("_t")).alias("slot")
    per_slot = toks.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("_c"))
    table = vectors.select("slot", vector_column("embedding").alias("_v"))
    hit = per_slot.join(F.broadcast(table) if small else table, "slot")
    pooled = hit.groupBy(*keys).agg(Summarizer.mean(F.col("_v"), F.col("_c")).alias("mean"), F.sum("_c").alias("n"))
    return pooled


def embed(df: DataFrame, vectors: DataFrame, n_vectors: int, id_col: str = "doc_id", text_col: str = "text",
          max_len: int = MAX_TOKENS, pad_to: str | None = None, max_broadcast_rows: int = 50_000) -> DataFrame:
    """Mean-pooled vector per text, long form ``(id, dim, value)``.

    Masked mean by default; with ``pad_to`` (a column with a padded length) the
    sum is divided by that length instead, as if padding had zero vectors. Texts
    without tokens have no rows."""
    pooled = pooled_vectors(df, vectors, n_vectors, id_col, text_col, max_len, (pad_to,) if pad_to else (), max_broadcast_rows)
    value = vector_to_array("mean")
    if pad_to:
        value = F.transform(value, lambda x: x * F.col("n") / F.col(pad_to))
    return pooled.select(id_col, F.posexplode(value).alias("dim", "value")).select(
        id_col, F.col("dim").cast("long").alias("dim"), "value")


def as_vectors(long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long form back to ``(id, embedding array<double>)`` (one small group per id)."""
    return long.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("embedding"))


class MeanPoolEncoder:
    """E3 predictor: the vector table is written once to the shared folder
    (size checked) and each Python worker loads it into a NumPy matrix once;
    a batch of slot lists is pooled with NumPy."""

    def __init__(self, spark, vectors: DataFrame, max_rows: int = 2_000_000):
        self.n_vectors = vectors.count()
        self.path = write_model_table(vectors.select("slot", "embedding"), "vector-table", max_rows,
                                      hint="embed joins a table of any size")
        self.key = f"enc-{uuid.uuid4().hex}"

    def load(self):
        path = self.path
        n = self.n_vectors

        def build():
            # batch by batch into one matrix of the table's own precision: no second copy of it
            matrix, seen, rows = None, np.zeros(n, dtype=bool), 0
            for batch in read_model_batches(path, ["slot", "embedding"]):
                if not batch.num_rows:
                    continue
                slots = batch.column("slot").to_numpy(zero_copy_only=False)
                values = np.asarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False))
                rows += len(slots)
                if rows > n or slots.min() < 0 or slots.max() >= n:
                    raise ValueError("vector slots must be 0..n-1")
                if matrix is None:
                    matrix = np.empty((n, len(values) // len(slots)), dtype=values.dtype)
                matrix[slots] = values.reshape(len(slots), matrix.shape[1])
                seen[slots] = True
            if not seen.all():
                raise ValueError("vector slots must be 0..n-1")
            return np.empty((0, 0)) if matrix is None else matrix

        return cached_state(self.key, build)

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Mean of each row's slot vectors: one gather for the whole batch and
        a segmented sum (``np.add.reduceat``); rows without tokens get NaN."""
        matrix = self.load()
        dim = matrix.shape[1]
        slot_lists = list(batch["slots"])
        lens = np.fromiter((0 if s is None else len(s) for s in slot_lists), dtype=np.int64, count=len(slot_lists))
        pooled = np.full((len(slot_lists), dim), np.nan)
        filled = lens > 0
        if filled.any():
            flat = np.concatenate([np.asarray(s, dtype=np.int64) for s, f in zip(slot_lists, filled) if f])
            starts = (np.cumsum(lens) - lens)[filled]
            pooled[filled] = np.add.reduceat(matrix[flat].astype(np.float64), starts, axis=0) / lens[filled][:, None]
        out = batch.drop(columns=["slots"]).copy()
        out["embedding"] = list(pooled)
        return out


def encode(df: DataFrame, encoder: MeanPoolEncoder, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = (), batch_size: int = 8, max_len: int = MAX_TOKENS,
           batch_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """``(id, *keep, embedding array<double>)`` through the predictor
    harness (exact batches, model once per worker).

    With ``batch_col`` (one of ``keep``) every encoder call gets the rows of
    exactly one batch id; the rows that move to it hold slots, not texts. A
    table that has ``slots`` (:func:`token_slots`) needs no text. With ``time_col`` the measured time of the call is
    added, in equal parts on its rows, so a sum by batch is the batch's time."""
    prepare(df.sparkSession)
    staged = df if "slots" in df.columns else token_slots(df, encoder.n_vectors, id_col, text_col, max_len, keep)
    if batch_col:
        spark = df.sparkSession
        staged = staged.repartitionByRange(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)), batch_col)
    staged = staged.select(id_col, *keep, "slots")
    fields = [f for f in staged.schema.fields if f.name != "slots"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", embedding array<double>"

    if time_col:
        schema += f", {time_col} double"

    def run_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        if not time_col:
            return encoder.predict(pdf)
        encoder.load()
        began = time.perf_counter()
        out = encoder.predict(pdf)
        out[time_col] = (time.perf_counter() - began) / len(pdf)
        return out

    if batch_col:
        return staged.sortWithinPartitions(batch_col).mapInPandas(_rebatch_by_key(run_batch, batch_col), schema)
    return staged.mapInPandas(_rebatch_by_count(run_batch, batch_size), schema)


def explode_vectors(df: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    return df.select(id_col, F.posexplode(vec_col).alias("dim", "value")).select(
        id_col, F.col("dim").cast("long").alias("dim"), "value")


def batch_stats(df: DataFrame, batch_col: str = "batch_id", time_col: str = "inference_time",
                vec_col: str = "embedding") -> DataFrame:
    """Per batch ``num_texts, embedding_dim, inference_time, throughput``
    (throughput null when the time is zero)."""
    per = df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("num_texts"),
        F.max(F.size(vec_col)).cast("long").alias("embedding_dim"),
        F.sum(time_col).alias("inference_time"),
    )
    return per.withColumn("throughput", F.when(F.col("inference_time") > 0,
                                               F.col("num_texts") / F.col("inference_time")))

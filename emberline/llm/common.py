"""Helpers shared by the training-data operators: staged tables in the shared
folder, joins and ranks that survive a key holding a third of all rows, and
Arrow access to whole text columns."""

from __future__ import annotations

import gc
import math
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import prepare, scratch_path, spread

# The six ASCII space characters of every contract: \x20 and \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]+"

# At most this many hot keys can hold more than 1/HOT_KEYS of the rows each,
# so a table of them is a broadcast with a proven row bound.
HOT_KEYS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's scan, dealt over all cores when its files give fewer splits."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, is
    computed once, and outlives any executor."""
    spark = prepare(df.sparkSession)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


COLLECT_SECONDS = 10
_collected = 0.0


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables whose successors are staged too: a job of many
    rounds then holds the tables of one round, not of all. Nothing that is still
    to be computed may read them. Temporary results only, never a given table.

    Shuffle files of finished jobs go when the driver collects the objects that
    stand for them, so it is asked to, every COLLECT_SECONDS at most."""
    global _collected
    if time.monotonic() - _collected > COLLECT_SECONDS:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()
        _collected = time.monotonic()
    for table in tables:
        spark = table.sparkSession
        for path in table.inputFiles()[:1]:
            folder = path.rsplit("/", 1)[0]
            if "/scratch/" in folder:
                where = spark._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int,
                  how: str = "left") -> DataFrame:
    """Join per-key facts back to rows, whatever share of the rows one key has.

    ``groups`` has one row per key and the key's row count in ``size``; the
    counts sum to at most ``total``, so at most HOT_KEYS keys exceed
    ``total / HOT_KEYS``. Those are broadcast and their rows never move; the
    remaining keys are bounded and go through a shuffle join. Both inputs
    should be staged tables, as each is read twice. Keys must not be null."""
    hot = F.broadcast(groups.where(F.col(size) > max(1, total // HOT_KEYS)))
    cold = groups.where(F.col(size) <= max(1, total // HOT_KEYS))
    in_hot = rows.join(hot, keys, "inner")
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return in_hot.unionByName(rest.select(*in_hot.columns))


def ranked(df: DataFrame, keys: list[str], tie: list[str], total: int, out: str = "rank",
           rows_per_bucket: int = 5_000) -> DataFrame:
    """Number the rows of each key from 0, in an order fixed by ``tie``.

    A key's rows are split into hash buckets, ranked inside (key, bucket), and
    shifted by the running count of the buckets before, so the largest task
    holds about ``1/buckets`` of the hottest key."""
    buckets = max(16, math.ceil(total / rows_per_bucket))
    cut = df.withColumn("__b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*tie)
    numbered = cut.withColumn("__r", F.row_number().over(inside) - 1)
    return numbered.join(starts, [*keys, "__b"]).withColumn(out, F.col("__start") + F.col("__r")).drop(
        "__b", "__r", "__start")


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)``: ``(id, component)`` with the
    smallest id of each component, for every id that has an edge.

    Union-find as joins: each round hooks every root to the smallest root seen
    across an edge (an aggregate with map-side combine), then halves the paths
    by pointer jumping until the forest is flat. Edges inside one component are
    dropped as soon as they are, so the work shrinks geometrically. Every round
    is a staged table; only counts reach the driver."""
    e = staged(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    ids = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
    forest = staged(ids.select("id", F.col("id").alias("component")), "forest")
    for _ in range(max_rounds):
        if e.isEmpty():
            return forest
        up = e.groupBy("a").agg(F.min("b").alias("up"))
        before, forest = forest, staged(forest.join(up, forest["component"] == up["a"], "left").select(
            "id", F.coalesce("up", "component").alias("component")), "forest")
        dropped(before)
        while True:  # pointer jumping: every id points to its parent's parent
            parent = forest.select(F.col("id").alias("p"), F.col("component").alias("pp"))
            jumped = forest.join(parent, forest["component"] == parent["p"]).select(
                "id", F.col("pp").alias("component"), (F.col("pp") != F.col("component")).alias("moved"))
            jumped = staged(jumped, "forest")
            dropped(forest)
            forest = jumped.select("id", "component")
            if jumped.where("moved").isEmpty():
                break
        left = forest.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        right = forest.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        before, e = e, staged(e.join(left, "a").join(right, "b").where("ca <> cb").select(
            F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), "edges")
        dropped(before)
    raise RuntimeError("components did not converge")


def fold(cols: list[Column], fn) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = fn(out, c)
    return out


# ---- whole text columns as bytes, inside Arrow tasks ------------------------

def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string column, nulls as empty texts."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset:]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), on whole arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """Consecutive rows of a batch, about ``limit`` bytes of text at a time (a
    longer text is whole and alone): bounds what array work holds at once."""
    sizes = batch.column(column).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that do not cross a text's edge: first byte, end
    byte, and how many runs each text has."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offsets))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: see ``runs``."""
    return runs(~_IS_SPACE[raw], offsets)


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, nothing else changed."""
    return _LOWER[raw]


class SpanHash:
    """64-bit hashes of byte spans: a polynomial over the bytes from prefix
    sums (no per-word Python), then mixed. Equal spans hash alike anywhere."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame | None, by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with one fact row per key, where some keys hold
    many rows. ``hot`` lists those keys (a table with a proven row bound, as
    keys above 1/HOT_KEYS of the rows); their rows are dealt over as many salts
    as there are shuffle partitions, and their facts are copied to each salt. None: there are none."""
    if hot is None:
        return rows.join(facts, key)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flag = F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot")))
    left = rows.join(flag, key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    right = facts.join(flag, key, "left").withColumn("__salt", F.explode(
        F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")


# A fixed-size set sketch: MAP_BITS bits in rows of 4 KB, so 2 MB at any input size.
MAP_BITS = 1 << 24


def bit_map(ids: DataFrame, col: str) -> DataFrame:
    """``ids[col]`` (64-bit hashes) as a bitmap of fixed size."""
    at = F.pmod(F.col(col), F.lit(MAP_BITS))
    return ids.select((at / 32768).cast("int").alias("__page"), (at % 32768).alias("__bit")).groupBy("__page").agg(
        F.bitmap_construct_agg("__bit").alias("__map"))


def maybe_in(rows: DataFrame, bitmap: DataFrame, col: str, flag: str = "__maybe") -> DataFrame:
    """Adds ``flag``: false only where ``col`` surely is not among the ids of
    the bitmap (2 MB, broadcast). Spares rows a shuffle; decides nothing."""
    at = F.pmod(F.col(col), F.lit(MAP_BITS))
    cut = rows.withColumns({"__page": (at / 32768).cast("int"), "__bit": (at % 32768).cast("int")})
    hit = F.expr("(cast(conv(hex(substring(__map, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int) >> (__bit % 8)) & 1")
    return cut.join(F.broadcast(bitmap), "__page", "left").withColumn(
        flag, F.coalesce(hit == 1, F.lit(False))).drop("__page", "__bit", "__map")


def later_copies(rows: DataFrame) -> DataFrame:
    """Adds ``later`` to rows ``(row, dh, ...)``, ``row`` a struct of all columns
    and ``dh`` a hash of id and text: true for all but one of the rows that repeat
    both (equal rows are alike; of rows that differ in other columns, the one
    with the smallest hash of them all stays)."""
    twice = staged(rows.groupBy("dh").agg(F.count("*").alias("n")).where("n > 1").select("dh"), "twice")
    if twice.isEmpty():
        return rows.withColumn("later", F.lit(False))
    marked = maybe_in(rows, staged(bit_map(twice, "dh"), "map"), "dh")
    # stored, so that a row's number is the same whenever it is read
    some = staged(marked.where("__maybe").drop("__maybe").withColumns(
        {"tie": F.xxhash64(F.to_json("row")), "number": F.monotonically_increasing_id()}), "copies")
    stay = some.groupBy("dh").agg(F.min(F.struct("tie", "number")).alias("s")).select("s.number", F.lit(True).alias("stays"))
    later = some.join(stay, "number", "left").withColumn("later", F.col("stays").isNull())
    return marked.where("not __maybe").drop("__maybe").withColumn("later", F.lit(False)).unionByName(
        later.select(*rows.columns, "later"))

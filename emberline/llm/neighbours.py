"""Approximate nearest neighbours (largest inner product) by learned partitions.

Fit, on a bounded sample: a neighbour graph, a balanced partitioning of that
graph (so that neighbours mostly share a part), and a small neural classifier
that predicts, from a vector, how its neighbours spread over the parts. Index:
every row goes to its most probable part. Search: a query goes to its most
probable parts; rows met there are ranked by the exact measure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, staged

FIT_SAMPLE = 8192  # rows the graph and the classifier are fitted on, at most
FIT_BYTES = 16 << 20  # and bytes of their vectors
GRAPH_DEGREE = 32
ROWS_PER_PART = 16  # of the sample: how many parts it can teach
ROWS_PER_BLOCK = 2048
PROBE_SHARE = 0.6  # of the parts, probed by each query
LEAST = 50
K = 20


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows that take part: ``(vec_id, v)`` with no null id, and a vector that
    is not null, empty or zero and holds only finite numbers."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def neighbour_graph(x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) to each row's ``degree`` largest inner products."""
    n = len(x)
    degree = min(degree, n - 1)
    src, dst = [], []
    for at in range(0, n, 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        best = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        src.append(np.repeat(np.arange(at, at + len(s)), degree))
        dst.append(best.ravel())
    return np.concatenate(src), np.concatenate(dst)


def balanced_parts(n: int, src: np.ndarray, dst: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Halve the graph again and again: each half is cut at the median of the
    slowest mode of a random walk on it, so parts are equal in size and few
    edges cross; then nodes swap sides in pairs while that saves edges."""
    rng = np.random.default_rng(seed)
    label = np.zeros(n, np.int64)
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(int(math.log2(parts))):
        inside = label[a] == label[b]
        ia, ib = a[inside], b[inside]
        degree = np.bincount(ia, minlength=n) + 1e-9
        f = rng.standard_normal(n)
        weight = np.bincount(label, degree)
        for _ in range(120):
            f = 0.5 * f + 0.5 * np.bincount(ia, f[ib], minlength=n) / degree
            f -= (np.bincount(label, f * degree) / weight)[label]  # without the constant mode
            f /= np.sqrt(np.bincount(label, f * f * degree) / weight + 1e-30)[label]
        order = np.lexsort((f, label))
        place = np.arange(n) - np.searchsorted(label[order], label[order])
        size = np.bincount(label)[label[order]]
        side = np.zeros(n, np.int64)
        side[order] = place >= (size + 1) // 2
        for _ in range(10):
            away = np.bincount(ia, side[ia] != side[ib], minlength=n)
            gain = 2 * away - np.bincount(ia, minlength=n)
            moved = 0
            for part in range(label.max() + 1):
                here = label == part
                left = np.flatnonzero(here & (side == 0) & (gain > 0))
                right = np.flatnonzero(here & (side == 1) & (gain > 0))
                m = min(len(left), len(right)) // 2
                if m:
                    side[left[np.argsort(-gain[left])[:m]]] = 1
                    side[right[np.argsort(-gain[right])[:m]]] = 0
                    moved += m
            if not moved:
                break
        label = label * 2 + side
    return label


class Router:
    """A one-layer network from a vector to part probabilities."""

    def __init__(self, w1, b1, w2, b2) -> None:
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, hidden: int = 256, epochs: int = 15, seed: int = 7) -> Router:
        rng = np.random.default_rng(seed)
        parts = target.shape[1]
        p = [rng.standard_normal((x.shape[1], hidden)) * math.sqrt(2 / x.shape[1]), np.zeros(hidden),
             rng.standard_normal((hidden, parts)) * math.sqrt(2 / hidden), np.zeros(parts)]
        m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at:at + 256]
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                q = np.exp(z - z.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                dz = (q - target[rows]) / len(rows)
                dh = (dz @ p[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 0.004 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return cls(*p)

    def scores(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(sample: np.ndarray, parts: int) -> Router:
    src, dst = neighbour_graph(sample.astype(np.float32), GRAPH_DEGREE)
    label = balanced_parts(len(sample), src, dst, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (src, label[dst]), 1.0)
    np.add.at(target, (np.arange(len(sample)), label), 2.0)
    return Router.fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), target / target.sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arr.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(arr), -1) if len(arr) else np.zeros((0, 1))


def _block_top(k: int):
    """The ``k`` best ids of one block, each by its best row, for every query sent to it."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, qids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        if not len(ids) or not len(qids):
            return schema.empty_table()
        x, q = _matrix(rows["v"]), _matrix(queries["v"])
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # row of each id
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), 256):
            s = q[at:at + 256] @ x.T
            s[qids[at:at + 256, None] == ids[None, :]] = -np.inf
            if len(first) > k:
                of_id = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)
                edge = -np.partition(-of_id, k - 1, axis=1)[:, k - 1]
                # whatever a rounding error could lift over the edge is measured again below
                mine, near = np.nonzero((s >= (edge - 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None]) & (s > -np.inf))
            else:
                mine, near = np.nonzero(s > -np.inf)
            score = (q[at + mine] * x[near]).sum(axis=1)
            order = np.lexsort((-score, ids[near], mine))
            mine, near, score = mine[order], near[order], score[order]
            best = np.ones(len(mine), bool)  # each id's best row
            best[1:] = (mine[1:] != mine[:-1]) | (ids[near[1:]] != ids[near[:-1]])
            mine, near, score = mine[best], near[best], score[best]
            order = np.lexsort((ids[near], -score, mine))
            mine, near, score = mine[order], near[order], score[order]
            place = np.arange(len(mine)) - np.searchsorted(mine, mine)
            top = place < k
            out.append((qids[at + mine[top]], ids[near[top]], score[top]))
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def search(table: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
           probe_share: float = PROBE_SHARE, fit_sample: int = FIT_SAMPLE, parts: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row with ``is_query(vec_id)``
    the ``k`` largest inner products among all other rows it meets, ties to the
    smaller id.

    Rows that ``valid_vectors`` leaves out take no part, nor do vectors of
    another dimension than most; repeated ids count once per query, by their
    best row; an empty table gives no rows. Every row is indexed, equal rows once. There is a part for every
    ROWS_PER_PART sampled rows, and each part is cut into blocks of bounded size, as are the queries sent to it, so a part that
    draws a third of all rows is many tasks. Where the probed parts hold fewer
    than ``LEAST * k`` ids, more parts are probed, all if need be."""
    spark = table.sparkSession
    rows = staged(valid_vectors(table, id_col, vector_col).groupBy("vec_id", "v").agg(F.count("*").alias("n")), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    rows = rows.where(F.size("v") == dim).drop("n")
    bound = max(64, min(fit_sample, FIT_BYTES // (8 * dim)))
    # the rows with the lowest hashed ids: bounded, and the same on every run
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(bound).select("v").toArrow()
    learn = _matrix(sample["v"])
    parts = parts or 1 << int(math.log2(max(1, len(learn) // ROWS_PER_PART)))
    probes = max(1, math.ceil(probe_share * parts))
    router = fit_router(learn, parts) if parts > 1 else None
    state = spark.sparkContext.broadcast(router)  # some (dim + parts) * 256 numbers

    routed = f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, parts array<int>"

    def route(choose):
        """Rows with the parts that ``choose`` takes of each row's ranking."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if state.value is None:
                    order = np.zeros((batch.num_rows, 1), np.int32)
                else:
                    order = np.argsort(-state.value.scores(_matrix(batch.column(1))), axis=1, kind="stable").astype(np.int32)
                taken = choose(order)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32),
                                                 pa.array(order[taken]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "parts"])
        return run

    def first(order: np.ndarray) -> np.ndarray:
        return np.arange(order.shape[1])[None, :] < np.ones((len(order), 1))

    index = staged(rows.mapInArrow(route(first), routed).select(
        F.col("parts")[0].alias("part"), "vec_id", "v"), "index")
    held, known = np.zeros(parts, np.int64), np.zeros(parts, np.int64)  # rows and ids of each part
    for r in index.groupBy("part", "vec_id").agg(F.count("*").alias("n")).groupBy("part").agg(
            F.sum("n").alias("n"), F.count("*").alias("ids")).collect():
        held[r["part"]], known[r["part"]] = r["n"], r["ids"]

    def probed(order: np.ndarray) -> np.ndarray:
        before = np.cumsum(known[order], axis=1) - known[order]
        return (np.arange(order.shape[1])[None, :] < probes) | (before < LEAST * k)

    asked = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"]).mapInArrow(route(probed), routed)
    queries = staged(asked.select(F.col("vec_id").alias("query_id"), "v", F.explode("parts").alias("part")), "queries")
    sent = queries.groupBy("part").agg(F.count("*").alias("n")).collect()  # one row for each part

    def blocks(counts: list, name: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(
            [(int(p), max(1, math.ceil(n / ROWS_PER_BLOCK))) for p, n in counts], f"part int, {name} int"))

    rows_of = blocks(list(enumerate(held.tolist())), "rbs")
    queries_of = blocks([(r["part"], r["n"]) for r in sent], "qbs")
    grid = [index.join(rows_of, "part").join(queries_of, "part"), queries.join(rows_of, "part").join(queries_of, "part")]

    def own(keys: list[str], n: str) -> F.Column:
        return F.pmod(F.xxhash64(*keys), F.col(n)).cast("int")

    def each(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = grid[0].withColumn("rb", own(["vec_id", "v"], "rbs")).withColumn("qb", each("qbs")).select("part", "rb", "qb", "vec_id", "v")
    right = grid[1].withColumn("qb", own(["query_id"], "qbs")).withColumn("rb", each("rbs")).select("part", "rb", "qb", "query_id", "v")
    near = left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInArrow(
        _block_top(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id may come from several blocks; of those with its best row, it is among the k best ids
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector among all others."""
    return search(read_table(spark, sf_dir, "embeddings"), lambda v: v % 20 == 0)

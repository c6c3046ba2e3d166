"""Data-parallel softmax classifier.

Re-aimed from an image network to a linear softmax model over feature arrays.
Data stays on the executors: every pass is one Spark job in which each task
computes its partition's gradient sum, loss sum and hit counts with NumPy and
emits them in long form; a normal aggregate adds the partials. Only the
K x D weights live on the driver (momentum SGD) and travel out as a broadcast.

Difference from the reference, stated: the default step is one full pass
(full-batch gradient) per epoch; :func:`train_batches` gives global mini-batches
(one job per step), :func:`fit_local` mini-batches in every task, averaged once
per epoch (one job per epoch).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket
from ..session import prepare
from .batching import assign_batches

# The reference trainer's schedule (lr 0.1, momentum 0.9,
# x0.1 at epochs 150, 250 and 350).
LR = 0.1
MOMENTUM = 0.9
MILESTONES = (150, 250, 350)
GAMMA = 0.1


def split(df: DataFrame, key: str, val_pct: int = 20) -> DataFrame:
    """Fixed membership: ``md5(key)`` bucket < ``val_pct`` -> 'val'."""
    return df.withColumn("split", F.when(md5_bucket(100, F.col(key)) < val_pct, F.lit("val")).otherwise(F.lit("train")))


def channel_stats(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Per-dimension mean and population std: ``(dim, mean, std)``."""
    return (df.select(F.posexplode(vec_col).alias("dim", "x"))
              .groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")))


def constants_row(train: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Constants for :func:`standardise` from training rows, as one row of two
    arrays ``(mean, std)`` in the order of the dimensions; they stay on Spark."""
    stats = F.sort_array(F.collect_list(F.struct("dim", "mean", "std")))
    return channel_stats(train, vec_col).agg(stats.alias("c")).select("c.mean", "c.std")


def standardise(df: DataFrame, mean: list[float] | DataFrame, std: list[float] | None = None, vec_col: str = "embedding",
                out: str = "features") -> DataFrame:
    """``(x - mean) / std`` per dimension with given constants (a
    dimension with std 0 keeps ``x - mean``): two lists, or the one row of
    :func:`constants_row`. They reach the rows as one row of two arrays, so a
    plan does not grow with the number of dimensions."""
    if not isinstance(mean, DataFrame):
        mean = df.sparkSession.createDataFrame([([float(v) for v in mean], [float(v) for v in std])],
                                               "mean array<double>, std array<double>")
    # scalar subqueries: run once, and every task has their two arrays
    given = df.withColumns({"__mean": mean.select("mean").scalar(), "__std": mean.select(
        F.transform("std", lambda v: F.when(v == 0, F.lit(1.0)).otherwise(v))).scalar()})
    centred = F.zip_with(F.col(vec_col), F.col("__mean"), lambda x, a: x.cast("double") - a)
    return given.withColumn(out, F.zip_with(centred, F.col("__std"), lambda x, b: x / b)).drop("__mean", "__std")


def fit_standardiser(train: DataFrame, vec_col: str = "embedding", max_dims: int = 100_000) -> tuple[list, list]:
    """The constants as lists on the driver (bounded by ``max_dims``), to be
    kept beside a model; :func:`constants_row` keeps them on Spark."""
    stats = channel_stats(train, vec_col).orderBy("dim").limit(max_dims + 1).collect()
    if len(stats) > max_dims:
        raise ValueError("too many dimensions")
    return [r["mean"] for r in stats], [r["std"] for r in stats]


def train_batches(df: DataFrame, key: str, batch_rows: int, workers: int = 1) -> DataFrame:
    """Global mini-batches of ``batch_rows * workers`` rows -> ``step_id``."""
    return assign_batches(df, key, batch_rows * workers, batch_col="step_id")


def lr_at(epoch, lr: float = LR, milestones=MILESTONES, gamma: float = GAMMA):
    """Stepped rate, ``lr * gamma ** (milestones passed)``. Works on a
    Python int or on a Column."""
    if isinstance(epoch, int):
        return lr * gamma ** sum(1 for m in milestones if epoch >= m)
    passed = sum((F.when(epoch >= F.lit(m), 1).otherwise(0) for m in milestones), F.lit(0))
    return F.lit(lr) * F.pow(F.lit(gamma), passed)


def _features_matrix(col, d: int) -> np.ndarray:
    """An Arrow list column of equal-length rows as an (n, d) float matrix,
    without touching rows one by one."""
    arr = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    n = len(arr)
    if n == 0:
        return np.zeros((0, d))
    lengths = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    if arr.null_count or not (lengths == d).all():
        raise ValueError(f"every feature row must have {d} values")
    return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, d)


def _partials_fn(weights_bc, k: int, d: int, vec_col: str, label_col: str, split_col: str | None):
    """Per-task pass over Arrow batches: gradient sums over train rows, loss
    sum, counts and hits for each split; emitted as one small batch of long
    rows ``(trial, kind, split, k, j, value)``."""

    def run(it):
        w_all = weights_bc.value  # (T, K, D)
        n_trials = w_all.shape[0]
        g = np.zeros_like(w_all)
        stats: dict[tuple, float] = {}
        for batch in it:
            if batch.num_rows == 0:
                continue
            x = _features_matrix(batch.column(vec_col), d)
            y = batch.column(label_col).to_numpy(zero_copy_only=False).astype(np.int64)
            splits = (np.asarray(batch.column(split_col).to_pylist(), dtype=object) if split_col
                      else np.full(len(y), "train", dtype=object))
            onehot = np.zeros((len(y), k))
            onehot[np.arange(len(y)), y] = 1.0
            names = np.unique(splits)
            for t in range(n_trials):
                s = x @ w_all[t].T
                top = s.max(axis=1, keepdims=True)
                e = np.exp(s - top)
                z = e.sum(axis=1, keepdims=True)
                p = e / z
                loss = -(((s - top) - np.log(z)) * onehot).sum(axis=1)
                hit = (s.argmax(axis=1) == y).astype(np.float64)
                for name in names:
                    mask = splits == name
                    for kind, vals in (("n", mask.astype(np.float64)), ("loss", loss * mask), ("hit", hit * mask)):
                        stats[(t, kind, name)] = stats.get((t, kind, name), 0.0) + float(vals.sum())
                train = splits == "train"
                if train.any():
                    g[t] += (p[train] - onehot[train]).T @ x[train]
        tt, kk, jj = np.meshgrid(np.arange(n_trials), np.arange(k), np.arange(d), indexing="ij")
        cols = {
            "trial": list(tt.ravel().astype(np.int32)) + [t for (t, _, _) in stats],
            "kind": ["grad"] * g.size + [kind for (_, kind, _) in stats],
            "split": ["train"] * g.size + [name for (_, _, name) in stats],
            "k": list(kk.ravel().astype(np.int32)) + [-1] * len(stats),
            "j": list(jj.ravel().astype(np.int32)) + [-1] * len(stats),
            "value": list(g.ravel()) + list(stats.values()),
        }
        yield pa.RecordBatch.from_pydict(cols, schema=PARTIAL_SCHEMA)

    return run


PARTIAL_SCHEMA = pa.schema([("trial", pa.int32()), ("kind", pa.string()), ("split", pa.string()),
                           ("k", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])


def pass_stats(df: DataFrame, weights: np.ndarray, vec_col: str = "features", label_col: str = "label",
               split_col: str | None = "split", one_step: bool = False) -> dict:
    """One data pass for a stack of weight matrices ``(T, K, D)``: per trial
    the mean gradient over train rows, and loss / accuracy per split. Returns
    plain NumPy on the driver (size T x K x D). ``one_step`` is for the rows of
    one mini-batch, a file or two: their partials come as they are, in one stage."""
    spark: SparkSession = df.sparkSession
    prepare(spark)
    t_, k, d = weights.shape
    bc = spark.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))
    cols = [vec_col, label_col] + ([split_col] if split_col else [])
    partial = df.select(*cols).mapInArrow(
        _partials_fn(bc, k, d, vec_col, label_col, split_col),
        "trial int, kind string, split string, k int, j int, value double")
    total = partial if one_step else partial.groupBy("trial", "kind", "split", "k", "j").agg(F.sum("value").alias("value"))
    grad = np.zeros((t_, k, d))
    stats: dict = {}
    for r in total.collect():  # bounded: T*K*D + a few rows per trial (per file of one step)
        if r["kind"] == "grad":
            grad[r["trial"], r["k"], r["j"]] += r["value"]
        else:
            key = (r["trial"], r["kind"], r["split"])
            stats[key] = stats.get(key, 0.0) + r["value"]
    bc.unpersist()
    out = {"grad": grad, "loss": {}, "accuracy": {}, "n": {}}
    for t in range(t_):
        n_train = stats.get((t, "n", "train"), 0.0)
        if n_train:
            out["grad"][t] /= n_train
        for (tt, kind, name), v in stats.items():
            if tt != t or kind == "n":
                continue
            n = stats.get((t, "n", name), 0.0)
            val = v / n if n else float("nan")
            out["loss" if kind == "loss" else "accuracy"][(t, name)] = val
        for (tt, kind, name), v in stats.items():
            if tt == t and kind == "n":
                out["n"][(t, name)] = v
    return out


def num_classes(df: DataFrame, label_col: str = "label") -> int:
    return int(df.agg(F.max(label_col)).first()[0]) + 1


def feature_dim(df: DataFrame, vec_col: str = "features") -> int:
    return int(df.agg(F.max(F.size(vec_col))).first()[0])


def gradient(df: DataFrame, weights: np.ndarray, **kw) -> np.ndarray:
    """T4: mean cross-entropy gradient ``(K, D)`` over train rows."""
    return pass_stats(df, weights[None, ...], **kw)["grad"][0]


def cross_entropy(df: DataFrame, weights: np.ndarray, split_name: str = "train", **kw) -> float:
    """Mean cross-entropy of the rows of ``split_name``."""
    return pass_stats(df, weights[None, ...], **kw)["loss"].get((0, split_name), float("nan"))


def step_table(df: DataFrame, key: str, batch_rows: int, workers: int = 1) -> DataFrame:
    """T2 stored for training: train rows with ``step_id`` written to the
    shared folder partitioned by step, so a step's filter prunes to one
    folder instead of scanning every row (partition pruning)."""
    from ..session import scratch_path
    from ..sinks.writers import write_parquet

    train = df.filter(F.col("split") == "train") if "split" in df.columns else df
    steps = train_batches(train, key, batch_rows, workers)
    path = scratch_path(df.sparkSession, "train-steps")
    write_parquet(steps.drop("row_idx"), path, partition_by=["step_id"])
    return df.sparkSession.read.parquet(path)


def fit_softmax(df: DataFrame, epochs: int, lr: float = LR, momentum: float = MOMENTUM, milestones=MILESTONES,
                gamma: float = GAMMA, max_steps: int | None = None, vec_col: str = "features",
                label_col: str = "label", n_classes: int | None = None, steps: DataFrame | None = None):
    """T5 + T6 + T8 (+ T9 with ``max_steps``): SGD with momentum.

    Default: one full-batch step per epoch (one Spark job per epoch). With
    ``steps`` (from :func:`step_table`) every epoch walks the global
    mini-batches in ``step_id`` order, one job per step reading only that
    step's folder; ``max_steps`` caps the total number of steps (smoke mode).
    Returns ``(weights, history rows)``: per epoch ``lr``, the mean train
    loss / accuracy over the epoch's steps (measured at the weights each step
    starts from) and validation loss / accuracy at the weights the epoch ends
    with."""
    k = n_classes or num_classes(df, label_col)
    d = feature_dim(df, vec_col)
    w = np.zeros((k, d))
    v = np.zeros_like(w)
    history = []
    if steps is None:
        n_steps = epochs if max_steps is None else min(epochs, max_steps)
        stats = pass_stats(df, w[None], vec_col=vec_col, label_col=label_col)
        for epoch in range(n_steps):
            rate = lr_at(epoch, lr, milestones, gamma)
            v = momentum * v + stats["grad"][0]
            w = w - rate * v
            before = stats
            stats = pass_stats(df, w[None], vec_col=vec_col, label_col=label_col)
            history.append({
                "epoch": epoch, "lr": rate,
                "loss": before["loss"].get((0, "train"), float("nan")),
                "accuracy": before["accuracy"].get((0, "train"), float("nan")),
                "val_loss": stats["loss"].get((0, "val"), float("nan")),
                "val_accuracy": stats["accuracy"].get((0, "val"), float("nan")),
            })
        return w, history
    # step ids are dense (0..S-1, from the global index), so one aggregate gives them all
    n_steps = steps.agg(F.max("step_id")).first()[0]
    step_ids = range(0 if n_steps is None else n_steps + 1)
    val = df.filter(F.col("split") == "val") if "split" in df.columns else None
    done = 0
    for epoch in range(epochs):
        rate = lr_at(epoch, lr, milestones, gamma)
        losses, accs, sizes = [], [], []
        for sid in step_ids:
            if max_steps is not None and done >= max_steps:
                break
            part = steps.filter(F.col("step_id") == sid)
            st = pass_stats(part, w[None], vec_col=vec_col, label_col=label_col, split_col=None, one_step=True)
            v = momentum * v + st["grad"][0]
            w = w - rate * v
            losses.append(st["loss"][(0, "train")])
            accs.append(st["accuracy"][(0, "train")])
            sizes.append(st["n"][(0, "train")])
            done += 1
        if not sizes:
            break
        vs = pass_stats(val, w[None], vec_col=vec_col, label_col=label_col, split_col=None) if val is not None \
            else {"loss": {}, "accuracy": {}}
        history.append({
            "epoch": epoch, "lr": rate,
            "loss": float(np.average(losses, weights=sizes)), "accuracy": float(np.average(accs, weights=sizes)),
            "val_loss": vs["loss"].get((0, "train"), float("nan")),
            "val_accuracy": vs["accuracy"].get((0, "train"), float("nan")),
        })
    return w, history


def _local_walks(weights_bc, rate: float, momentum: float, batch_rows: int, k: int, d: int):
    """Per-task walks: every worker's rows come together and in key order; its
    model starts from the round's weights and takes a step each ``batch_rows``
    rows. Emits the sum over the task's workers of rows x weights, and totals."""

    def run(it):
        start = weights_bc.value
        total, stats = np.zeros((k, d)), np.zeros(3)  # rows, loss, hits
        worker, rows = None, 0
        held_x, held_y, held = [], [], 0
        w, v = start, np.zeros((k, d))

        def step():
            nonlocal w, v, held_x, held_y, held
            x, y = np.concatenate(held_x), np.concatenate(held_y)
            held_x, held_y, held = [], [], 0
            s = x @ w.T
            top = s.max(axis=1, keepdims=True)
            e = np.exp(s - top)
            z = e.sum(axis=1, keepdims=True)
            at = np.arange(len(y))
            stats[:] += len(y), -(s - top - np.log(z))[at, y].sum(), (s.argmax(axis=1) == y).sum()
            p = e / z
            p[at, y] -= 1.0
            v = momentum * v + p.T @ x / len(y)
            w = w - rate * v

        def close():
            nonlocal total
            if held:
                step()
            if rows:
                total = total + rows * w

        for batch in it:
            ids = batch.column("worker").to_numpy(zero_copy_only=False)
            x, y = _features_matrix(batch.column("x"), d), batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(ids):
                if ids[at] != worker:
                    close()
                    worker, rows, w, v = ids[at], 0, start, np.zeros((k, d))
                same = int(np.searchsorted(ids, worker, side="right"))
                stop = min(same, at + batch_rows - held)
                held_x.append(x[at:stop])
                held_y.append(y[at:stop])
                held, rows, at = held + stop - at, rows + stop - at, stop
                if held == batch_rows:
                    step()
        close()
        kk, jj = np.meshgrid(np.arange(k), np.arange(d), indexing="ij")
        yield pa.RecordBatch.from_pydict({
            "k": np.r_[kk.ravel(), [-1] * 3].astype(np.int32), "j": np.r_[jj.ravel(), np.arange(3)].astype(np.int32),
            "value": np.r_[total.ravel(), stats]}, schema=pa.schema([("k", pa.int32()), ("j", pa.int32()), ("value", pa.float64())]))

    return run


def fit_local(df: DataFrame, key: str, rounds: int, workers: int, batch_rows: int, lr: float = LR,
              momentum: float = MOMENTUM, milestones=MILESTONES, gamma: float = GAMMA, vec_col: str = "features",
              label_col: str = "label", n_classes: int | None = None):
    """T2 + T5 with one job per epoch: local SGD. A train row belongs to worker
    ``md5(key) mod workers`` for good. In a round every worker starts from the
    common weights (momentum zero), walks its rows in key order, a step for each
    ``batch_rows`` of them, and the workers' weights are averaged by their rows.
    So a round costs one pass and one model, however many steps it has; result
    and number of steps depend on ``workers``, never on the cluster.

    Rows are partitioned and sorted once and kept for all rounds; a task streams
    its workers' rows and holds one step of them. ``workers`` should be a few
    times the cluster's cores. Returns ``(weights, history)``: per round ``lr``,
    loss and accuracy of the train rows as the steps met them, and of the
    validation rows with the averaged weights."""
    spark: SparkSession = df.sparkSession
    prepare(spark)
    k, d = n_classes or num_classes(df, label_col), feature_dim(df, vec_col)
    train, val = (df.filter(F.col("split") == name) for name in ("train", "val"))
    held = train.select(md5_bucket(workers, F.col(key)).alias("worker"), F.col(key).alias("key"), F.col(vec_col).alias("x"),
                        F.col(label_col).alias("y")).repartition("worker").sortWithinPartitions("worker", "key").persist(
        StorageLevel.DISK_ONLY)
    w, history = np.zeros((k, d)), []
    try:
        for r in range(rounds):
            rate = lr_at(r, lr, milestones, gamma)
            bc = spark.sparkContext.broadcast(w)
            sums = held.select("worker", "x", "y").mapInArrow(
                _local_walks(bc, rate, momentum, batch_rows, k, d), "k int, j int, value double")
            total, stats = np.zeros((k, d)), np.zeros(3)
            for row in sums.groupBy("k", "j").agg(F.sum("value").alias("value")).collect():  # K x D + 3 rows
                if row["k"] < 0:
                    stats[row["j"]] = row["value"]
                else:
                    total[row["k"], row["j"]] = row["value"]
            bc.unpersist()
            if not stats[0]:
                break
            w = total / stats[0]
            after = pass_stats(val, w[None], vec_col=vec_col, label_col=label_col, split_col=None)
            history.append({"epoch": r, "lr": rate, "loss": stats[1] / stats[0], "accuracy": stats[2] / stats[0],
                            "val_loss": after["loss"].get((0, "train"), float("nan")),
                            "val_accuracy": after["accuracy"].get((0, "train"), float("nan"))})
    finally:
        held.unpersist()
    return w, history


def history_frame(spark: SparkSession, history: list[dict]) -> DataFrame:
    """The epoch report as a DataFrame (append it to Parquet per run)."""
    schema = "epoch long, lr double, loss double, accuracy double, val_loss double, val_accuracy double"
    return spark.createDataFrame([(int(h["epoch"]), float(h["lr"]), float(h["loss"]), float(h["accuracy"]),
                                   float(h["val_loss"]), float(h["val_accuracy"])) for h in history], schema)


def weights_frame(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """Weights in long form ``(class, dim, weight)``."""
    k, d = w.shape
    rows = [(int(a), int(b), float(w[a, b])) for a in range(k) for b in range(d)]
    return spark.createDataFrame(rows, "class long, dim long, weight double")


def predict(df: DataFrame, w: np.ndarray, vec_col: str = "features", out: str = "prediction") -> DataFrame:
    """Arg-max class of ``x . w_k`` in the JVM (first class on ties)."""
    scores = [F.aggregate(F.zip_with(F.col(vec_col), F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b),
                          F.lit(0.0), lambda acc, x: acc + x) for row in w]
    arr = F.array(*scores)
    return df.withColumn(out, (F.array_position(arr, F.array_max(arr)) - 1).cast("long"))


def evaluate(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction",
             by: str | None = "split") -> DataFrame:
    """Accuracy (and row count) per split."""
    hit = (F.col(pred_col) == F.col(label_col)).cast("double")
    g = pred.groupBy(by) if by else pred.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def confusion(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    return pred.groupBy(label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))

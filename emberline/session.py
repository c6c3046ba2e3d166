"""Session helpers: a tuned local session for tests, shared scratch space,
reliable checkpoints and size-checked broadcasts.

Everything that must survive an executor loss is written under the folder the
cluster names in ``spark.checkpoint.dir``. We only pick our own folder when
that setting is unset *and* the master is local (tests, laptops).
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", app: str = "emberline", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session tuned like a small cluster: AQE on, UTC, Arrow on."""
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``emberline`` importable on every executor: the package is zipped
    once per application into the shared checkpoint folder and handed to
    ``addPyFile`` (Spark distributes it). Python steps (``mapInPandas``
    predictors, gradient partials) unpickle classes and functions from it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = f"{scratch_path(spark, 'code')}/emberline.zip"
    fs, where = _arrow_fs(target)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(where) as out:
        out.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def _arrow_fs(path: str):
    """pyarrow file system and path for a Spark-style location: ``file:``
    paths, plain paths, or URIs pyarrow understands (``hdfs://``, ``s3://``;
    ``s3a://`` is read as ``s3://``)."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder + package on the executors; cheap after the first call."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only for
    local masters where the cluster has not named any."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS, S3, NFS) for checkpoints and scratch tables")
    local = tempfile.mkdtemp(prefix="emberline-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir for written
    tables (round trips, stream inputs, step tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    # keep the scheme (hdfs://, s3a://, file:): the path is only used by Spark readers and writers
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, holds no
    executor memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *read: DataFrame) -> None:
    """Deletes the tables in the scratch folder that ``read`` are read from: their
    successors are written and nothing reads them again. Given tables stay.

    Shuffle files of finished jobs go when the driver collects the objects that
    stand for them, so it is asked to."""
    gc.collect()
    spark._jvm.System.gc()
    here = ensure_checkpoint_dir(spark).split(":", 1)[-1].strip("/") + "/scratch/"
    for folder in {path.rsplit("/", 1)[0] for table in read for path in table.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(here):
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared dir) that cuts lineage.

    The frame is persisted for the duration of the write, so the eager count
    and the checkpoint write share one computation instead of two."""
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, min_tasks: int | None = None) -> DataFrame:
    """Round-robin a *scan* over at least ``min_tasks`` partitions (default:
    the cluster's parallelism) when its files give fewer splits, before a
    CPU-heavy step (tokenising, Python predictors). Call it on a scan: the
    split count of a scan is known from planning alone (no job). Large inputs
    already have far more splits than cores, so it is a no-op there."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    want = min_tasks or spark.sparkContext.defaultParallelism
    try:
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. remote sessions): leave as is
        return df
    return df.repartition(want) if have < want else df


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has no more than ``max_rows`` rows; stops early."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 200_000) -> DataFrame:
    """Join ``small`` into ``big``: broadcast when its row count is proven to be
    under ``max_rows``, otherwise a shuffle join (AQE may still re-plan or
    split skewed keys)."""
    if has_at_most(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def write_model_table(df: DataFrame, name: str, max_rows: int, sort_keys: list | None = None,
                      group_key: str | None = None, hint: str = "") -> str:
    """Write a model table to the shared folder for Python workers to load
    themselves (the driver only passes the path), then check it has at most
    ``max_rows`` rows: the count comes from the written Parquet, so the model
    is computed once. ``name`` becomes a folder, ``hint`` goes into the error. With ``group_key``, each group's rows land in one file,
    sorted by ``sort_keys`` inside it (range partitioning by the group key)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df
    if group_key is not None:
        n = max(1, spark.sparkContext.defaultParallelism)
        out = out.repartitionByRange(n, group_key).sortWithinPartitions(*(sort_keys or [group_key]))
    out.write.mode("overwrite").parquet(path)
    if spark.read.parquet(path).count() > max_rows:
        raise ValueError(f"{name} has more than {max_rows} rows" + (f" ({hint})" if hint else ""))
    return path


def read_model_table(path: str, columns: list[str]):
    """Inside a Python worker: the model table as one Arrow table (files in
    name order). Local ``file:`` paths and URIs pyarrow understands
    (``hdfs://``, ``s3://``; ``s3a://`` is mapped to ``s3://``) are accepted."""
    import pyarrow.dataset as ds

    fs, root = _arrow_fs(path)
    dataset = ds.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=True)
    return dataset.to_table(columns=columns)


def read_model_batches(path: str, columns: list[str], rows: int = 8192):
    """As :func:`read_model_table`, but record batches one after the other."""
    import pyarrow.dataset as ds

    fs, root = _arrow_fs(path)
    dataset = ds.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=True)
    return dataset.to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1)

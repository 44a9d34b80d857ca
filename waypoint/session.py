"""Session helpers: local session for tests/bench, shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "waypoint", conf: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WAYPOINT_DRIVER_MEMORY", "8g")))
    for k, v in (conf or {}).items():  # the caller's settings win
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system);
    only a local-mode session without it gets a private folder under /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    try:
        master = spark.sparkContext.master
    except Exception:  # noqa: BLE001 - remote session: the server owns the folder
        master = "remote"
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    base = tempfile.mkdtemp(prefix="waypoint-ckpt-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    base = checkpoint_base(spark)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session
        return base
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base + "/rdd")
    return base


_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (or the current run scope)."""
    base = _SCOPES[-1] if _SCOPES else f"{ensure_checkpoint_dir(spark)}/scratch"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def run_scratch(spark: SparkSession, name: str = "run"):
    """Route stage tables of one job run into their own folder; remove it afterwards."""
    folder = scratch_path(spark, name)
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.pop()
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            fs.delete(path, True)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """Within it, a write's shuffle files go as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old is not None else spark.conf.unset(name)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, more: Iterable[DataFrame] = (),
                **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) under the shared folder and read it back.

    ``more``: frames of the same columns, whose rows are added one frame after the other.

    Cuts the lineage (recovery re-reads files instead of recomputing), and
    later readers get column pruning, pushed filters and partition pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for i, x in enumerate((df, *more)):
        w = x.write.mode("append" if i else "errorifexists").options(**options)
        if partition_by:
            w = w.partitionBy(*partition_by)
        with short_shuffles(spark):
            w.parquet(path)
    if partition_by:  # no file tells the columns of an empty table, nor a folder's name its type
        return spark.read.schema(df.schema).parquet(path)
    return spark.read.parquet(path)


def balance(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores.

    A table stored as one large row group scans as a single task; a
    round-robin exchange then lets the rest of the stage use every core. On
    inputs with enough splits (any large table) this is a no-op.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave as is
        return df
    return df.repartition(cores) if splits < cores else df

"""Session helpers: a tuned builder, and shared scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # text tables are CPU-bound (regex tokenising): smaller splits, more parallel tasks
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def build_session(master: str | None = None, app: str = "lectio",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session for tests and the benchmark.  Keys already set by the launcher
    or ``spark-defaults.conf`` are kept; only unset keys get these defaults."""
    from pyspark import SparkConf

    master = master or os.environ.get("LECTIO_MASTER", "local[8]")
    present = dict(SparkConf().getAll())
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULTS.items():
        if k not in present:
            b = b.config(k, v)
    if "spark.driver.memory" not in present:
        b = b.config("spark.driver.memory", os.environ.get("LECTIO_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``).  Only when it is unset in local mode (tests) a
    private folder is created and registered; on a cluster that is an error,
    since executors cannot see the driver's own folders."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="lectio-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/lectio-{name}-{uuid.uuid4().hex[:12]}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under spark.checkpoint.dir and read it back: computed
    once, and with a lineage of files that every executor sees."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

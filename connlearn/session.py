"""Session helpers: a local session for tests and benchmarks, and the shared
staging folder (``spark.checkpoint.dir``) for written intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "connlearn") -> SparkSession:
    """Session used by tests and ``bench.py``; never used by library code."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared (distributed)
    folder; it is read, never replaced. Only a local-mode session without the
    setting (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set: name a shared folder for this cluster")
        conf = tempfile.mkdtemp(prefix="connlearn-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/connlearn-staging/{name}-{uuid.uuid4().hex}"


def staged(df, name: str):
    """Write ``df`` to a fresh shared folder and read it back: whatever reads
    it sees the same rows, also where ``df`` is not deterministic, and lineage
    ends there."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Delete everything that :func:`staging_path` handed out below the
    session's checkpoint folder. Call it when no frame that reads staged
    tables is needed any more (they are read lazily)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/connlearn-staging")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def spread(df, min_partitions: int | None = None, by: list[str] | None = None):
    """Re-partition a frame that arrives in fewer partitions than the
    cluster has cores (one unsplittable file, a one-row-group Parquet file,
    one gzip file). Inputs that are already split pass through untouched, so
    at scale this costs nothing; below it, one small shuffle buys parallel
    parsing, encoding and optimiser passes.

    ``by``: hash-partition on a high-cardinality key (deterministic on
    recomputation without the local sort a round-robin repartition needs);
    without it, round-robin.
    """
    spark = df.sparkSession
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()       # plans the scan; runs no job
    except AttributeError:  # a Spark Connect session has neither: leave it to AQE
        return df
    if have >= want:
        return df
    return df.repartition(want, *by) if by else df.repartition(want)


def read_table(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None,
               spread_by: list[str] | None = None):
    """A driver table, pruned to ``columns`` before any spreading."""
    df = spark.read.parquet(table_path(sf_dir, table))
    if columns:
        df = df.select(*columns)
    return spread(df, by=spread_by)

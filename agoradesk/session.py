"""Session settings and the few places where a job needs shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "agoradesk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC clock, adaptive plans)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder below the one the cluster names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: name a folder every executor can reach")
    return os.path.join(base, *parts)


_LOCAL: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write rows below ``spark.checkpoint.dir`` and read them back, so that iterative plans stay short and survive lost executors.

    A local session without that setting gets one temporary folder of its own.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local"):
        base = shared_dir(spark)
    else:
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="agoradesk-")
        _LOCAL[spark.sparkContext.applicationId] = base
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Use every core on a scan with fewer splits than cores (a small file before heavy text work).

    A large table has more splits than the cluster has cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

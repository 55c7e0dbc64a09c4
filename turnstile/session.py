"""Session construction and the shared working folder.

Library code never creates its own session: every operator takes the caller's
``SparkSession``.  ``build_session`` exists for tests, ``bench.py`` and scripts.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "turnstile", extra: dict | None = None) -> SparkSession:
    """Local session with AQE on, UI off and a UTC session zone."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session (or from a checkpoint folder already set on its
    context).  Only a local master without either, as in tests, gets a folder
    of its own; on any other master executors would not share it, so the
    setting is required.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not is_one_machine(sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="turnstile-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def is_one_machine(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[4]``, ...)."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared folder for one job's output."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/turnstile/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "materialized"):
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Used where a plan is read several times (multi-pass statistics), so the
    upstream shuffles run once.  The written table cuts the lineage, lives in
    the cluster-shared folder (so it survives executor loss, unlike
    ``localCheckpoint``) and is columnar and compressed, unlike an RDD
    checkpoint's serialized rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

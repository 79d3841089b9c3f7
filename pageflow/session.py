"""Session helpers: a tuned local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "pageflow") -> SparkSession:
    """A session with AQE on, UI off and UTC time; used by tests and bench.

    On a cluster the session comes from the launcher; nothing here is needed there.
    """
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # broadcast joins only from sizes AQE measured at run time, never from plan estimates
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/DBFS) folder there; it is read from the
    session. Only in local mode, when it is unset (tests), a scratch folder is made; on a
    cluster a missing setting is an error rather than a silent driver-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
            "(HDFS/S3/DBFS); a driver-local folder would not be visible to executors"
        )
    local = tempfile.mkdtemp(prefix="pageflow-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scale_conf(input_bytes: int, cores: int, html_heavy: bool = True) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume (apply with ``spark.conf.set``
    or at submit time). Shuffle partitions target ~200 MB each after AQE's coalescing; a
    page table (long html strings) is read in 128 MB splits so a task's decoded rows fit
    in executor memory; skewed join partitions are split by AQE.
    """
    target = 200 * 1024 * 1024
    parts = max(cores * 2, input_bytes // target or 1)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.files.maxPartitionBytes": str((128 if html_heavy else 256) * 1024 * 1024),
        # broadcast only what AQE *measured* small at run time; no broadcast from plan estimates
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }

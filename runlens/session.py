"""Session construction and the shared scratch location.

On a cluster the scratch location is the shared folder named by
``spark.checkpoint.dir``; we only pick our own (a fresh ``/tmp`` folder) when the
session has none, which is the local-test case.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "runlens") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(shuffle_bytes: int | None = None, cores: int | None = None) -> dict[str, str]:
    """Settings for large clusters (apply with ``SparkSession.builder.config(map=...)``).

    - AQE on, with skew-join splitting and partition coalescing; the initial shuffle
      partition count from the expected shuffle volume (~128 MB per partition) so
      that partitions fit executor memory, at least 2x the cores;
    - scan splits of 256 MB;
    - Arrow batches for the Python pass bounded by rows *and* bytes (whole texts:
      a batch never exceeds 64 MB per worker);
    - the checkpoint folder is *not* set here: it is the cluster's shared folder
      (``spark.checkpoint.dir``), read by :func:`ensure_checkpoint_dir`."""
    parts = max(2 * (cores or 1), (shuffle_bytes or 0) // (128 << 20), 200)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.python.worker.reuse": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote clients: the server owns the context
        sc = None
    current = spark.conf.get(_CHECKPOINT_KEY, None) or (sc.getCheckpointDir() if sc else None)
    if current:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    master = sc.master if sc is not None else ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="runlens-ckpt-")
    spark.conf.set(_CHECKPOINT_KEY, local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    # the context may report a sub folder of its own; keep ours beside it
    return f"{base}/runlens-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable ``checkpoint()`` into the
    shared checkpoint folder (survives executor loss; never a local checkpoint).
    Used where an expensive result (e.g. the Python extraction pass) feeds more than
    one branch of a plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

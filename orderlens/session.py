"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

# Optimizer settings the library is designed for. AQE re-plans joins at
# runtime (a measured, not guessed, broadcast), splits skewed partitions of
# sort-merge joins and coalesces small shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key (e.g. one order with a third of the lines) even
    # when that costs an extra exchange before the next aggregate
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # lines partitioned by order number (the shuffle join with orders at
    # scale) may feed joins on (order_number, shop) without a re-shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
                 shuffle_fraction: float = 0.3, max_shuffle_partitions: int = 100_000) -> dict:
    """Sizing for a cluster run: scan splits of about ``target_partition_bytes``
    and shuffle partitions sized to the bytes actually shuffled (the pruned,
    partially aggregated ``shuffle_fraction`` of the input), at least three
    tasks per core, capped because map-output bookkeeping grows with mappers x
    reducers; AQE coalesces small shuffles and splits skewed ones. Merge the
    result into the session config."""
    shuffled = int(input_bytes * shuffle_fraction)
    shuffle_partitions = min(max_shuffle_partitions,
                             max(3 * total_cores, -(-shuffled // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        **RECOMMENDED_CONF,
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "orderlens",
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A local-mode session for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("ORDERLENS_DRIVER_MEMORY", "8g"))
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    When the setting exists it is used as is (and handed to the SparkContext if
    only the SQL conf carries it). Only a local-mode session without the
    setting (tests, the bench) gets a fresh folder of its own; a cluster
    session without it is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
    path = fallback or tempfile.mkdtemp(prefix="orderlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def check_session(spark: SparkSession) -> list[str]:
    """Settings the plans rely on that this session has otherwise (hot orders
    are split, and lines stay partitioned by order, only under them), and a
    checkpoint folder that looks machine-local on a cluster. Each is warned
    about once an application; nothing is changed."""
    found = [f"{k} is {have}, not {v}" for k, v in RECOMMENDED_CONF.items() if (have := _setting(spark, k)) not in (v, None)]
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or ""
    if not sc.master.startswith("local") and (folder.startswith("file:") or folder.startswith("/")):
        found.append(f"spark.checkpoint.dir is {folder}: it must be a folder that all executors share")
    if found and _CHECKED.get("app") != sc.applicationId:
        warnings.warn("; ".join(found), stacklevel=3)
    _CHECKED["app"] = sc.applicationId
    return found


_CHECKED: dict[str, str] = {}


def _setting(spark: SparkSession, key: str) -> str | None:
    """A setting's value or Spark's own default for it; None if this Spark does
    not know it. (A default passed to ``get`` is checked against the setting's
    type and may raise.) A diagnostic never fails a query."""
    try:
        return spark.conf.get(key)
    except Exception:  # noqa: BLE001
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now: it does
    so when the driver's garbage collector finds that nothing refers to them."""
    spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a written table's folder, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_once(df):
    """Reliable checkpoint to the shared folder, computing ``df`` only once.

    A reliable checkpoint runs one job to count and a second one to write the
    files, recomputing the input in between unless it is persisted; the input
    is therefore persisted for the duration of the checkpoint (memory, then
    disk) and released right after. Lineage is cut; never ``localCheckpoint``.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()

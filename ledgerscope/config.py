"""Session settings the reports rely on, and the checkpoint directory rule.

On a cluster the session is built by the platform; ``tune`` only fills in
settings that are unset.  ``local_session`` is for tests and the benchmark.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that matter for these plans.  AQE re-plans joins from measured
# sizes (runtime broadcast of small aggregates, skew-join splitting of hot
# keys, partition coalescing); UTC keeps timestamp-without-zone data stable.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Defaults of Spark that these plans need otherwise: bucket pruning must also
# work where the key set is not broadcast.
REPLACED = {"spark.sql.optimizer.dynamicPartitionPruning.reuseBroadcastOnly": ("true", "false")}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``RECOMMENDED`` for keys the session reports no value for.

    Spark 4 already defaults the AQE and ANSI keys to these values; none that
    is set is overridden.  ``REPLACED`` keys are changed from Spark's default.
    """
    for key, value in RECOMMENDED.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    for key, (default, value) in REPLACED.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only if the session has none.

    A cluster names a shared directory in ``spark.checkpoint.dir``; that is
    used as is.  Only an unconfigured local-mode session (tests, the
    benchmark) gets a fresh temporary directory; on a cluster a missing
    setting is an error, because a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared directory (e.g. on the cluster's file system); "
                "the reports checkpoint small key sets and sorted results there"
            )
        configured = tempfile.mkdtemp(prefix="ledgerscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "ledgerscope") -> SparkSession:
    """A local session for tests and benchmarks (no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "8g")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(fact_bytes: int, cores: int, target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for facts of ``fact_bytes`` on ``cores`` executor cores.

    Shuffles of the reports carry partial aggregates, far smaller than the
    facts, so the input size is an upper bound: start with one shuffle
    partition per ``target_partition_bytes`` of facts (at least two waves of
    tasks) and let AQE coalesce them to the advisory size.
    Scans split files at 256 MB so a task's input fits in memory with room
    for its aggregation buffers; skewed join partitions above five times
    the median and 4x the advisory size are split.
    """
    initial = max(2 * cores, -(-fact_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def size_for(spark: SparkSession, fact_paths: list[str], cores: int) -> dict[str, str]:
    """Apply ``scale_settings`` for the stored size of the facts under ``fact_paths``; returns what was set."""
    from ledgerscope.sources.tables import stored_bytes

    settings = scale_settings(stored_bytes(spark, fact_paths), cores)
    for key, value in settings.items():
        spark.conf.set(key, value)
    return settings

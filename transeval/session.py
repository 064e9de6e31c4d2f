"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job here relies on: AQE re-plans joins from runtime sizes and
# splits skewed join partitions; UTC keeps formatted dates engine-independent.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow UDFs here take whole program texts (up to ~100 KB each): smaller batches keep
    # a Python worker's batch in the tens of MB instead of ~1 GB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; a fused stage
    # above that runs interpreted. With this limit Spark splits such stages instead
    # (measured: verdict queries 1.6-1.8x faster).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "transeval", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above. The master is set only if asked
    for: under ``spark-submit`` the cluster decides, and so do its shuffle partitions and its
    ``spark.checkpoint.dir``, unless ``conf`` names them."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` (it must be on shared storage). Only a
    local session (tests, benchmarks) without one gets a fresh scratch folder; on a
    cluster a missing setting is an error rather than a machine-local guess.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        path = tempfile.mkdtemp(prefix="transeval-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


@contextmanager
def partitions_as_text(spark: SparkSession) -> Iterator[None]:
    """Within it, what names a partition's folder is read as text: a model ``007`` or a
    temperature ``0.20`` is no number."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scale_settings(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large run: scan splits and shuffle partitions of about
    ``partition_bytes`` each (fits an executor core's memory with room to spill), at
    least two partitions per core; AQE coalesces small ones and splits skewed joins."""
    parts = max(2 * cores, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }

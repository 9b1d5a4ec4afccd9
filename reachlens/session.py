"""Session settings the operators are written for."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

# Adaptive execution sizes partitions after each shuffle and splits skewed ones; the
# broadcast limit is the size check for every join side without an explicit hint.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
}


def session(app: str = "reachlens", **overrides: str) -> SparkSession:
    """A session with the settings above; keyword arguments replace or add to them,
    written with ``__`` for dots. The submitter sets what depends on the
    cluster: memory, cores, and ``spark.sql.shuffle.partitions`` high enough that a
    partition of the largest shuffle fits in memory; small shuffles are coalesced."""
    builder = SparkSession.builder.appName(app)
    extra = {key.replace("__", "."): value for key, value in overrides.items()}
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the folder the driver has it in, or from
    wherever it is installed on the executors."""
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent)
    return spark

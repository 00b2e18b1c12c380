"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the run-time work the plans rely on: small partitions are
# merged, skewed join partitions are split, and a join side is broadcast only when its
# measured size is below the threshold (nothing here raises it).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int = 8, memory: str = "8g", name: str = "holdfast") -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the session comes from the submit command; only ``SETTINGS`` matter.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

"""Session settings for tests, benchmarks and small jobs.

Library code never builds a session and never names a master; a cluster job brings its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Worth setting on a cluster too.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes. Beyond that, several smaller
    # generated projections are faster than one that is only interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fathom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()

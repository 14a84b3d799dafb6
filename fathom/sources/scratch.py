"""Written intermediate tables in the shared folder the cluster names.

A written table cuts lineage, gives every later pass the same rows in the same order, and
survives the loss of the executors that produced it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder named by the session, or in local mode a new one where none is set.

    Learners that cut their own lineage get the same folder.
    """
    context = spark.sparkContext
    root = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    if not root:
        # "local-cluster" has executors of its own, like any cluster.
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fathom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/fathom/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to shared scratch and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

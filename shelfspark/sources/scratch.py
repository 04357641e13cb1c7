"""Tables that a job writes for its own later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder that ``spark.checkpoint.dir`` names (a local one only where that is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/shelfspark-{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, partitioned by the columns ``by``: cuts lineage, outlives executors."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

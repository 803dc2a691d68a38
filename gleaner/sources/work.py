"""Work tables: what is written once so that no later step computes it anew, in a folder that all share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is not set, a local session gets a temporary
    folder, and a cluster's warehouse folder stands in."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        root = tempfile.mkdtemp(prefix="gleaner-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{root.rstrip('/')}/gleaner/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a work table: written and read back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

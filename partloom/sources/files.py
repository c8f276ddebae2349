"""Places for tables that outlive a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    """Under the folder that the cluster names in spark.checkpoint.dir; under one of our own where none is set and the master
    is local."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own = _own or f"file://{tempfile.mkdtemp(prefix='partloom-')}"
        base = _own
    return f"{base.rstrip('/')}/partloom-{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, for what several branches of a plan read: made once, kept if executors are lost."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def swap_generation(rows: DataFrame, base: str, generation: int) -> DataFrame:
    """Writes a whole new generation beside the old ones; readers of the one returned never see half of it."""
    path = f"{base}/generation={generation}"
    rows.write.mode("error").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

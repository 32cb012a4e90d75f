"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, on one machine, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _local.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="quarry-")
        _local[app] = named
    return f"{named.rstrip('/')}/quarry/{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so lost executors cost no more than their own tasks."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Scratch tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _roots:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _roots[key] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _roots[key]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/quarry/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeatable(df: DataFrame, tag: str) -> DataFrame:
    """df itself if it only selects from files, which give the same rows in the same order however often a task runs; else written()."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter") and node.deterministic():
        node = node.children().head()
    return df if node.nodeName() == "LogicalRelation" or "Relation" in node.nodeName() and df.inputFiles() else written(df, tag)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them must have been written before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/quarry/{spark.sparkContext.applicationId}")
    path.getFileSystem(conf).delete(path, True)

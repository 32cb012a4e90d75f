"""Versions of a stored table: numbered manifests that appear whole or not at all, on any file system that Spark knows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(conf), conf


def _name(path: str, number: int) -> str:
    return f"{path}/_versions/{number:09d}.json"


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Make content version number of path. The manifest is written aside and renamed, so it is never seen in part; if that version exists, another writer was first and nothing changes."""
    jvm, fs, conf = _system(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    if fs.exists(jvm.org.apache.hadoop.fs.Path(_name(path, number))):
        fs.delete(aside, False)
        raise FileExistsError(f"version {number} of {path} exists: it was changed meanwhile")
    try:
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(_name(path, number)), options)
    except Exception as e:
        fs.delete(aside, False)
        raise FileExistsError(f"version {number} of {path} could not be made: {e}") from e


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions of path, ascending."""
    jvm, fs, _ = _system(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def read(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """The manifest of a version, of the newest one by default."""
    if number is None:
        known = numbers(spark, path)
        if not known:
            raise FileNotFoundError(f"{path} has no versions")
        number = known[-1]
    lines = spark.sparkContext.wholeTextFiles(_name(path, number)).values().collect()  # one small file
    return json.loads(lines[0])


def drop(spark: SparkSession, path: str) -> bool:
    """Delete path and all its versions."""
    jvm, fs, _ = _system(spark, path)
    return fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)

"""Checks around changes that would replace, drop or leave short what a collection holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import versions
from quarry.operators import stored
from quarry.operators.store import Collection


def check_encoder(held: Collection | stored.Stored, primary: str, written: str) -> None:
    """Refuse to ingest under another vector than the primary one where chunks are held: they would be replaced, and lose it."""
    if written != primary and not held.chunks.isEmpty():
        raise ValueError(f"the collection holds chunks under {primary!r}; ingesting them as {written!r} would drop these vectors: attach the second vector instead")


def at_risk(held: Collection | stored.Stored, ids: DataFrame, written: str) -> DataFrame:
    """vector_name, n: vectors other than written that an upsert of ids(chunk_id) would drop; none is no row."""
    others = held.vectors.where(F.col("vector_name") != written).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return others.groupBy("vector_name").agg(F.countDistinct("chunk_id").alias("n"))


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """vector_name, lost, left: names of which vectors(chunk_id, vector_name) hold fewer chunks after than before."""
    count = lambda v, c: v.groupBy("vector_name").agg(F.countDistinct("chunk_id").alias(c))
    both = count(before, "before").join(count(after, "left"), "vector_name", "left").withColumn("left", F.coalesce("left", F.lit(0)))
    return both.where("left < before").select("vector_name", (F.col("before") - F.col("left")).alias("lost"), "left")


def build_hybrid(source: stored.Stored, path: str, *, reset: bool = False, **lexical) -> stored.Stored:
    """A copy of a stored collection at path that can be searched by words too; its vectors are the source's, bit by bit.

    The source stays as it is, so path must not be its own; an empty source and a path that
    holds chunks are refused, the latter unless reset. A copy that came out short is an error,
    as it would be compared with its source over fewer chunks.
    """
    spark = source.spark
    place = lambda p: versions._system(spark, p)[1].makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)).toString()
    if place(source.path) == place(path):
        raise ValueError(f"{path} is the source itself, which would be lost")
    wanted = (source.count(), source.vectors.count())
    if not wanted[0]:
        raise ValueError(f"{source.path} is empty")
    if versions.numbers(spark, path):
        if stored.open_stored(spark, path).count() and not reset:
            raise ValueError(f"{path} holds chunks already; reset builds it anew")
        versions.drop(spark, path)
    made = stored.create(spark, path, source.chunks, source.vectors, source.declared, hybrid=True, unit=True, **lexical)
    if (found := (made.count(), made.vectors.count())) != wanted:
        raise RuntimeError(f"the copy at {path} holds {found} chunks and vectors of {wanted}")
    return made

"""Seals of stored bundles: a tree of digests over their rows, made and checked in parallel, which names what was altered.

A row's place is given by the SHA-256 of its key, so places fill evenly whatever the keys
are: a leaf is a prefix of that digest, long enough that about sixteen rows meet in it, and
above it each node is the digest of the sixteen below. What is not altered keeps its place
and its digest, so two trees differ in the leaves of altered, missing and new rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scratch import written

_LEAF = 16


def _said(value: Column) -> Column:
    """A value with its length before it, so that no two rows are written alike; null is told from empty."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value))


def row_digests(rows: DataFrame, key: str) -> DataFrame:
    """place, digest: SHA-256 of a row's key and of its columns by name. Arrays, maps and structs count as their JSON."""
    flat = lambda f: F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() not in ("array", "map", "struct") else F.to_json(f"`{f.name}`")
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    whole = F.concat(*(F.concat(F.lit(f"{len(f.name)}:{f.name}="), _said(flat(f))) for f in fields))
    return rows.select(F.sha2(_said(F.col(f"`{key}`").cast("string")), 256).alias("place"), F.sha2(whole, 256).alias("digest"))


def depth_for(rows: int) -> int:
    """Digits of a leaf's prefix: the fewest that leave about sixteen rows or fewer a leaf."""
    depth = 0
    while rows > _LEAF ** (depth + 1):
        depth += 1
    return depth


def leaves(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """node, digest, n: a row for each leaf that is not empty. Keys must be unique: a repeated one fails the job, so no leaf grows with a key."""
    own = row_digests(rows, key).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest"))
    own = own.withColumn("digest", F.when(F.col("n") == 1, F.col("digest")).otherwise(F.raise_error(F.lit(f"a value of {key} occurs more than once"))))
    held = F.array_sort(F.collect_list(F.struct("place", "digest")))
    return own.groupBy(F.substring("place", 1, depth).alias("node")).agg(F.sha2(F.array_join(F.transform(held, lambda x: x["digest"]), ""), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def tree(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """node, digest, n of all nodes: leaves first, then the levels above them, up to the root, whose name is empty."""
    out = level = written(leaves(rows, key, depth), "leaves")  # rows are read once, not for every level
    for d in range(depth - 1, -1, -1):
        below = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy(F.substring("node", 1, d).alias("node")).agg(F.sha2(F.array_join(F.transform(below, lambda x: F.concat(x["node"], F.lit("="), x["digest"])), " "), 256).alias("digest"), F.sum("n").alias("n"))
        out = out.unionByName(level)
    return out


def seal(rows: DataFrame, key: str, path: str) -> str:
    """Write the leaves of rows to path; returns the root, which proves them and is to be kept apart from the bundle. Nothing is the digest of no rows."""
    depth = depth_for(rows.count())
    leaves(rows, key, depth).withColumn("depth", F.lit(depth)).write.mode("overwrite").parquet(path)
    return root(rows.sparkSession, path)


def root(spark: SparkSession, path: str) -> str:
    """The root of the leaves that were written to path."""
    level = spark.read.parquet(path)
    depth = level.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for d in range(depth - 1, -1, -1):
        below = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy(F.substring("node", 1, d).alias("node")).agg(F.sha2(F.array_join(F.transform(below, lambda x: F.concat(x["node"], F.lit("="), x["digest"])), " "), 256).alias("digest"))
    top = level.select("digest").first()
    return top[0] if top else level.sparkSession.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def altered(rows: DataFrame, key: str, path: str, *, proof: str | None = None) -> DataFrame:
    """node, sealed, found, keys: the leaves in which rows differ from what was sealed at path, and the keys that are in them now; none if all is as it was.

    proof: the root that seal() returned; leaves that it does not prove are refused, as
    who alters a bundle may alter its seal. Missing rows show as a leaf that differs.
    """
    spark = rows.sparkSession
    if proof is not None and root(spark, path) != proof:
        raise ValueError(f"the seal at {path} is not the one that was made")
    held = spark.read.parquet(path)
    depth = held.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    found = leaves(rows, key, depth).select("node", F.col("digest").alias("found"))
    differ = held.select("node", F.col("digest").alias("sealed")).join(found, "node", "full").where(~F.col("sealed").eqNullSafe(F.col("found")))
    where = F.substring(F.sha2(_said(F.col(f"`{key}`").cast("string")), 256), 1, depth)
    near = rows.select(where.alias("node"), F.col(f"`{key}`").alias("key")).join(differ.select("node"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return differ.join(near, "node", "left")

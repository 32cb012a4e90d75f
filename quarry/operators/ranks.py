"""Exact ranks and smallest rows of large groups, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.scratch import written
from quarry.shipping import ship

#: Rows of one group that a window orders in one task at most.
FEW = 4096
_STEP = 3
_HEX = 32


def _numbered(keys: int):
    """Rows in order of their keys with the partition's number and a count from 1 within each key's run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n = None, 0
        for batch in batches:
            place = []
            for key in zip(*(c.to_pylist() for c in batch.columns[:keys]), strict=True):
                n = n + 1 if key == last else 1
                last = key
                place.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "__part", "__place"])

    return run


def with_rank(rows: DataFrame, by: str, *order: str, rank: str = "rank", size: str = "n") -> DataFrame:
    """rows with rank, from 1 in each group of by by the columns order, and the group's size n.

    Rows are dealt by ranges of group and order, so a large group lies in many tasks. Each
    task numbers what it has of a group; the counts of the ranges before it, a row for
    each task and group, are added. order should tell rows apart: rows equal in all of it
    lie in one range, in any order. Null groups are a group; nulls come first.
    """
    spark = rows.sparkSession
    ship(spark)
    kinds = T.StructType([*rows.select(by, *(c for c in rows.columns if c != by)).schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__place", T.LongType())])
    dealt = rows.select(by, *(c for c in rows.columns if c != by)).repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    held = written(dealt.mapInArrow(_numbered(1), kinds), "ranges")  # what was drawn as ranges stays
    counts = held.groupBy(by, "__part").agg(F.max("__place").alias("__c"))
    mine = Window.partitionBy(by)
    before = counts.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), (F.sum("__c").over(mine.orderBy("__part")) - F.col("__c")).alias("__before"), F.sum("__c").over(mine).alias(size))
    joined = held.join(written(before, "counts"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(rank, F.col("__place") + F.col("__before")).select(*rows.columns, rank, size)


def smallest(rows: DataFrame, takes: DataFrame, by: str, key: Column, tie: str) -> DataFrame:
    """Of each group of by the first rows in order of key, then tie: as many as takes(by, take) says.

    key is a hash in hexadecimal digits. Rounds of counts by three digits more find the
    digits at which a group's last row lies, until few rows share them; only those are put
    in order. Rows that share the whole key are put in order of tie. Groups without a
    line in takes give no rows; null keys none.
    """
    digits = rows.select(F.col(by).alias("__g"), key.alias("__h"), F.col(tie).alias("__t")).where("__h is not null")
    left = written(takes.where("take > 0").groupBy(F.col(by).alias("__g")).agg(F.max("take").cast("long").alias("__left")).withColumn("__prefix", F.lit("")), "takes")
    for size in range(_STEP, _HEX + _STEP, _STEP):
        inside = digits.join(left, "__g").where(F.startswith("__h", "__prefix"))
        counts = inside.groupBy("__g", "__left", F.substring("__h", 1, min(size, _HEX)).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
        up = Window.partitionBy("__g").orderBy("__p")
        # at most 4,096 rows a group: the digits that may follow
        passed = counts.withColumn("__sum", F.sum("__n").over(up)).withColumn("__all", F.sum("__n").over(Window.partitionBy("__g")))
        at = passed.where((F.col("__sum") >= F.col("__left")) & (F.col("__sum") - F.col("__n") < F.col("__left")))
        all_of = passed.groupBy("__g").agg(F.max("__all").alias("__all"), F.first("__left").alias("__left")).where("__all < __left").select("__g", F.lit("~").alias("__prefix"), F.lit(0).cast("long").alias("__left"), F.lit(0).cast("long").alias("__n"))
        found = at.select("__g", F.col("__p").alias("__prefix"), (F.col("__left") - (F.col("__sum") - F.col("__n"))).alias("__left"), "__n").unionByName(all_of)
        done = left.where("__prefix = '~'").select("__g", "__prefix", "__left", F.lit(0).cast("long").alias("__n"))
        found = written(found.unionByName(done), "digits")
        left = found.drop("__n")
        if (found.agg(F.max("__n")).first()[0] or 0) <= FEW:
            break
    marked = rows.withColumn("__h", key).join(left.withColumnRenamed("__g", by), by)
    below = marked.where(F.col("__h") < F.col("__prefix"))
    edge = marked.where(F.startswith("__h", "__prefix"))
    edge = edge.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("__h", tie))).where(F.col("__r") <= F.col("__left")).drop("__r")
    return below.unionByName(edge).select(*rows.columns)

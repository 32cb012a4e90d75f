"""Grids of experiments: cells, what is still to run, and ranges over repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "label string, model string, repeat int, defenses array<string>, routes array<struct<corpus:string,landed:int,total:int,survivors:array<string>,abstained:int>>, answers map<string,double>, retrieval map<string,double>, seconds double, warm boolean"


def grid(spark: SparkSession, models: list[str], sets: list[str], repeats: int) -> DataFrame:
    """All cells, models slowest: position, model, label, repeat, key."""
    cells = [(i, m, s, r, f"{s}@{m}#{r}") for i, (m, s, r) in enumerate((m, s, r) for m in models for s in sets for r in range(1, repeats + 1))]
    return spark.createDataFrame(cells, "position int, model string, label string, repeat int, key string")


def pending(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells whose key was not recorded, in order."""
    keys = done.select(F.concat(F.col("label"), F.lit("@"), F.col("model"), F.lit("#"), F.coalesce("repeat", F.lit(1)).cast("string")).alias("key")).distinct()
    return cells.join(keys, "key", "left_anti").orderBy("position")


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Recorded rows; a missing file is an empty table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).json(path)


def record(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").json(path)


def ranges(runs: DataFrame, *by: str) -> DataFrame:
    """runs(run, total, survivors) by cell: repeats, fewest and most landed, and what landed in some runs only; repeats are never averaged."""
    sizes = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("repeats"), F.max("total").alias("total"), F.min(F.size("survivors")).cast("long").alias("landed_low"), F.max(F.size("survivors")).cast("long").alias("landed_high"))
    names = runs.select(*by, "run", F.explode(F.array_distinct("survivors")).alias("name")).groupBy(*by, "name").agg(F.countDistinct("run").alias("seen"))
    moved = names.join(sizes.select(*by, "repeats"), list(by)).where("seen < repeats").groupBy(*by).agg(F.array_sort(F.collect_list("name")).alias("unstable"))
    return sizes.join(moved, list(by), "left").withColumn("unstable", F.coalesce("unstable", F.array().cast("array<string>")))


def attack_ranges(rows: DataFrame) -> DataFrame:
    runs = rows.withColumn("r", F.explode("routes")).select("label", "model", "r.corpus", F.coalesce("repeat", F.lit(1)).alias("run"), "r.total", "r.survivors")
    return ranges(runs, "label", "model", "corpus")


def same_twice(first: DataFrame, second: DataFrame) -> bool:
    """Two runs of one arm must agree row by row."""
    return first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def utility_cells(rows: DataFrame, *, warm: bool) -> DataFrame:
    """Recorded rows as cells: label, model, repeat (1 if not recorded), utility, recall and warm, where the rows do not say so themselves."""
    said = lambda name: F.try_element_at("answers", F.lit(name))
    return rows.select("label", "model", F.coalesce("repeat", F.lit(1)).alias("repeat"), said("answer_utility").alias("utility"), said("answer_recall").alias("recall"), F.coalesce("warm", F.lit(warm)).alias("warm"))


def rewritten(baseline: DataFrame, treated: DataFrame, key: str = "query_id") -> DataFrame:
    """n, rewritten: treated answers(key, text), and those whose text is not the baseline's; a null text equals null only."""
    both = treated.select(key, F.col("text").alias("__new")).join(baseline.select(key, F.col("text").alias("__old")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("__new").eqNullSafe(F.col("__old"))).alias("rewritten"))

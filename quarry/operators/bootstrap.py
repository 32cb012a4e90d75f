"""Paired comparison by a bootstrap that merges: weights come from hashes, so every task adds to the same resamples."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.shipping import ship

#: Hashes are taken modulo this prime, so that products of two fit into 64 bits.
PRIME = (1 << 31) - 1
_ROWS = 512


def thresholds(most: int = 12) -> list[float]:
    """What the chances of a Poisson variable of mean 1 to be at most 0, 1, ... add up to."""
    return np.cumsum([math.exp(-1) / math.factorial(i) for i in range(most + 1)]).tolist()


def hashed(said: str) -> int:
    """The first 32 bits of an MD5 digest modulo PRIME."""
    return int(hashlib.md5(said.encode()).hexdigest()[:8], 16) % PRIME


def question_hash(question: Column, seed: int) -> Column:
    said = F.concat(F.lit(f"{seed}|"), question.cast("string"))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long") % PRIME


def _resampled(resamples: int, seed: int, groups: int, names: list[str], most_groups: int = 64):
    """Sums of weights and of weighted deltas of a task's questions, by group and resample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.array([hashed(f"{seed}|times|{r}") for r in range(resamples)], np.int64)
        shift = np.array([hashed(f"{seed}|plus|{r}") for r in range(resamples)], np.int64)
        steps = np.array(thresholds())
        held: dict[tuple, tuple[np.ndarray, np.ndarray, list]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for weights, deltas, key in held.values():
                columns = [pa.concat_arrays([c] * resamples) for c in key]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(resamples, dtype=np.int32)), pa.array(weights), pa.array(deltas)], names=names)
            held.clear()

        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:groups]), strict=True)) if groups else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            code = np.fromiter((number.setdefault(x, len(number)) for x in keys), np.int64, len(keys))
            question, delta = batch.column(groups).to_numpy(), batch.column(groups + 1).to_numpy()
            for key, g in number.items():
                mine = np.flatnonzero(code == g)
                if key not in held:
                    if len(held) >= most_groups:
                        yield from sent()
                    held[key] = np.zeros(resamples, np.int64), np.zeros(resamples), [c.slice(int(mine[0]), 1) for c in batch.columns[:groups]]
                weights, deltas, _ = held[key]
                for a in range(0, len(mine), _ROWS):
                    part = mine[a : a + _ROWS]
                    chance = (question[part, None] * factor[None, :] + shift[None, :]) % PRIME / PRIME
                    times = np.searchsorted(steps, chance, side="right")
                    weights += times.sum(axis=0)
                    deltas += delta[part] @ times
        yield from sent()

    return run


def pair_up(baseline: DataFrame, treated: DataFrame, *by: str) -> DataFrame:
    """by, question_id, baseline, treated of two tables (by, question_id, value): every question of either, null where one lacks it."""
    one, two = (x.select(*by, "question_id", F.col("value").cast("double").alias(n)) for x, n in ((baseline, "baseline"), (treated, "treated")))
    return one.join(two, [*by, "question_id"], "full")


def paired_delta(pairs: DataFrame, *by: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = 20260912) -> DataFrame:
    """pairs(question_id, baseline, treated) by group: n, mean_delta, low, high, lost, gained.

    low and high are percentiles of the means of resamples, in which a question counts as
    often as a Poisson variable of mean 1 that hashes of the question and of the resample
    decide. So a resample's mean is a quotient of sums, to which every task adds what its
    questions give: a group of any size is never in one task, and the result depends on
    neither order nor partitions (it is rounded to twelve digits). A resample that draws
    no question is left out. A question that one side lacks is an error; repeated
    questions of a group are drawn together. An empty table gives no rows by group, and
    without groups one row of n 0.
    """
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must lie between 0 and 1, not {confidence}")
    ship(pairs.sparkSession)
    lacking = F.raise_error(F.lit("a question lacks its counterpart"))
    delta = F.when(F.col("baseline").isNull() | F.col("treated").isNull(), lacking).otherwise(F.col("treated").cast("double") - F.col("baseline").cast("double"))
    keys = [f"__by{i}" for i in range(len(by))]
    rows = pairs.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), question_hash(F.col("question_id"), seed).alias("__q"), delta.alias("__d"))
    kinds = T.StructType([*(T.StructField(k, pairs.schema[c].dataType) for c, k in zip(by, keys, strict=True)), T.StructField("r", T.IntegerType()), T.StructField("w", T.LongType()), T.StructField("d", T.DoubleType())])
    drawn = rows.mapInArrow(_resampled(resamples, seed, len(by), kinds.names), kinds).groupBy(*keys, "r").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    tail = (1 - confidence) / 2
    means = F.col("d") / F.nullif(F.col("w"), F.lit(0))
    bounds = drawn.groupBy(*keys).agg(F.percentile(means, F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mean"), F.count_if(F.col("__d") < 0).alias("lost"), F.count_if(F.col("__d") > 0).alias("gained"))
    # null groups are groups too
    same = lambda x: [F.struct(F.lit(0), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), *(F.col(k).isNull() for k in keys)).alias("__same"), *x]
    both = told.select(*same([*keys, "n", "mean", "lost", "gained"])).join(bounds.select(*same(["p"])), "__same", "left")
    short = lambda c: F.round(c, 12)
    return both.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "n", short("mean").alias("mean_delta"), short(F.col("p")[0]).alias("low"), short(F.col("p")[1]).alias("high"), "lost", "gained")

"""Exact nearest neighbours between two large tables: vectors in cells, cells ruled out by bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quarry.operators.access import Principal, visible
from quarry.scratch import written
from quarry.shipping import ship

#: Cells at most, so that their centres can be sent to every task: 4,096 of 1,000 numbers are 33 MB.
MOST_CELLS = 4096
#: Vectors, and queries, that meet in one task at most, in expectation.
SLICE = 4096
_ROWS = 512


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return np.zeros((0, 0))
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300) if len(rows) else rows


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest each row, in blocks of rows."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + _ROWS] @ centres.T - half, axis=1) for i in range(0, len(rows), _ROWS)]) if len(rows) else np.zeros(0, np.int64)


def _sums(sent, unit: bool):
    """Of a task's rows, how many each cell has and what they add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        n, total = np.zeros(len(centres), np.int64), np.zeros_like(centres)
        for batch in batches:
            rows = _matrix(batch.column(0))
            if len(rows):
                rows = _unit(rows) if unit else rows
                cell = _closest(rows, centres)
                n += np.bincount(cell, minlength=len(centres))
                np.add.at(total, cell, rows)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(total[held].tolist(), pa.list_(pa.float64()))], names=["cell", "n", "total"])

    return run


def _assigned(sent, unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            rows = _matrix(batch.column(0))
            rows = _unit(rows) if unit else rows
            cell = _closest(rows, centres)
            gap = np.linalg.norm(rows - centres[cell], axis=1) if len(rows) else np.zeros(0)
            vectors = pa.array(list(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([vectors, *batch.columns[1:], pa.array(cell.astype(np.int32)), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

    return run


@dataclass(frozen=True)
class CellIndex:
    """rows(embedding, chunk_id, ..., cell, gap), dealt and sorted by cell; cells(cell, centre, radius, n, unit)."""

    rows: DataFrame
    cells: DataFrame

    def write(self, path: str) -> CellIndex:
        """Store both tables; the index that is read back from them scans the cells that a search needs."""
        self.rows.write.parquet(f"{path}/rows")
        self.cells.write.parquet(f"{path}/cells")
        return open_index(self.rows.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> CellIndex:
    return CellIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"))


def build(vectors: DataFrame, *, cells: int | None = None, unit: bool = False, rounds: int = 3, sample: int = 16) -> CellIndex:
    """Deal vectors(chunk_id, embedding, ...) to cells around centres found by k-means.

    cells defaults to half the root of the number of vectors, 4,096 at most; unit takes
    vectors at unit length. The centres are fitted in rounds of grouped sums on about
    sample vectors a cell, those of the smallest hashes of their ids; all vectors are
    dealt. The fit decides only how much a search reads, never what it finds. Rows without
    id or embedding are left out; an empty table gives an index without cells.
    """
    spark = vectors.sparkSession
    ship(spark)
    pool = vectors.where("embedding is not null and chunk_id is not null")
    pool = pool.select("embedding", *(c for c in pool.columns if c != "embedding")).withColumn("embedding", F.col("embedding").cast("array<double>"))
    n, short, long = pool.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if short != long:
        raise ValueError("vectors differ in their number of dimensions")
    wanted = min(MOST_CELLS, n, cells or max(1, round(math.sqrt(n) / 2)))
    order = F.xxhash64(F.col("chunk_id").cast("string"), F.lit(20260912))
    few = min(1.0, 1.5 * sample * wanted / max(n, 1))
    picked = written(pool.where(order / F.lit(2.0**64) + 0.5 < few if few < 1 else F.lit(True)).select("embedding", order.alias("h")), "sample")
    first = [r[0] for r in picked.orderBy("h").limit(wanted).select("embedding").collect()]
    if not first:
        kinds = T.StructType([*pool.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
        return CellIndex(spark.createDataFrame([], kinds), spark.createDataFrame([], "cell int, centre array<double>, radius double, n long, unit boolean"))
    centres = np.array(first, np.float64)
    centres = _unit(centres) if unit else centres
    added = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), centres.shape[1]), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)
        sums = picked.select("embedding").mapInArrow(_sums(sent, unit), "cell int, n long, total array<double>").groupBy("cell").agg(F.sum("n").alias("n"), added.alias("total"))
        centres = centres.copy()
        for r in sums.collect():  # a row a cell
            centres[r["cell"]] = np.array(r["total"]) / r["n"]
        sent.destroy()
    sent = spark.sparkContext.broadcast(centres)
    kinds = T.StructType([*pool.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    rows = written(pool.mapInArrow(_assigned(sent, unit), kinds).repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell"), "cells")
    sent.destroy()
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known = rows.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    return CellIndex(rows, written(middle.join(known, "cell").withColumn("unit", F.lit(unit)), "centres"))


@dataclass(frozen=True)
class _Cells:
    """What every task knows of the index: bounded by the number of cells."""

    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    n: np.ndarray
    unit: bool

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of centres, and what no vector of a cell can exceed: the centre's score and the cell's radius in the query's direction."""
        score = queries @ self.centre.T
        size = np.linalg.norm(queries, axis=1, keepdims=True)
        slack = 1e-9 * (1 + size * (self.radius + np.linalg.norm(self.centre, axis=1)))
        return score, score + size * self.radius + slack

    def first(self, score: np.ndarray, least: int) -> np.ndarray:
        """Cells to look into first: the nearest centres, two at least, until they hold least vectors."""
        order = np.argsort(-score, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        take = (before < least) | (np.arange(order.shape[1]) < 2)
        out = np.zeros_like(take)
        np.put_along_axis(out, order, take, axis=1)
        return out


def _probes(sent, least: int, later: bool, kinds: T.StructType):
    """Each query once for each cell that it must look into: at first the nearest, later all that may hold a better hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Cells = sent.value
        for batch in batches:
            rows = _matrix(batch.column(1))
            rows = _unit(rows) if known.unit else rows
            for a in range(0, len(rows), _ROWS):
                part = rows[a : a + _ROWS]
                if part.shape[1] != known.centre.shape[1]:
                    raise ValueError("a query has other dimensions than the vectors")
                score, bound = known.bounds(part)
                wanted = known.first(score, least)
                floor = np.full(len(part), -np.inf)
                if later:
                    floor = batch.column(2).slice(a, _ROWS).to_numpy(zero_copy_only=False).astype(np.float64)
                    floor = np.where(np.isnan(floor), -np.inf, floor)
                    wanted = ~wanted & (bound >= floor[:, None])
                at, cell = np.nonzero(wanted)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * part.shape[1], pa.int32()), pa.array(part[at].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + a)), vectors, pa.array(floor[at]), pa.array(known.cell[cell].astype(np.int32))], names=kinds.names)

    return run


def _scored(k: int, exclude_self: bool, types: list[pa.DataType]):
    names = ["query_id", "chunk_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        right = right.sort_by("chunk_id")
        queries, vectors = _matrix(left["embedding"]), _matrix(right["embedding"])
        floor = left["floor"].to_numpy()
        same = None
        if exclude_self:
            who = pa.chunked_array([left["query_id"].combine_chunks().cast(pa.string()), right["chunk_id"].combine_chunks().cast(pa.string())]).combine_chunks().dictionary_encode().indices.to_numpy()
            same = who[: len(queries)], who[len(queries) :]
        out_q, out_c, out_s = [], [], []
        for a in range(0, len(queries), _ROWS):
            score = np.round(queries[a : a + _ROWS] @ vectors.T, 12)  # the same in whatever block a pair is met
            if same is not None:
                score[same[0][a : a + _ROWS, None] == same[1][None, :]] = -np.inf
            least = np.maximum(floor[a : a + _ROWS] - 1e-9, np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else -np.inf)
            at, nth = np.nonzero((score >= least[:, None]) & np.isfinite(score))
            order = np.lexsort((nth, -score[at, nth], at))
            at, nth = at[order], nth[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            out_q.append(at[keep] + a)
            out_c.append(nth[keep])
            out_s.append(score[at[keep], nth[keep]])
        at, nth = np.concatenate(out_q), np.concatenate(out_c)
        return pa.table([left["query_id"].take(pa.array(at)).cast(types[0]), right["chunk_id"].take(pa.array(nth)).cast(types[1]), pa.array(np.concatenate(out_s))], names=names)

    return run


def _met(probes: DataFrame, index: CellIndex, principal: Principal | None, k: int, exclude_self: bool, kinds: T.StructType) -> DataFrame:
    """The best k of each query in each slice of the cells that it looks into.

    A cell is cut into slices of 4,096 vectors by a hash of the id, its queries likewise, and
    each slice of one side meets each of the other in a task, so none depends on how large
    a cell is or how many queries want it.
    """
    probes = written(probes, "probes")
    wanted = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("q_parts"))
    sizes = F.broadcast(wanted.join(index.cells.select("cell", F.ceil(F.col("n") / SLICE).cast("int").alias("v_parts")), "cell"))  # at most MOST_CELLS rows
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    slot = lambda key, parts: F.pmod(F.xxhash64(F.col(key).cast("string")), F.col(parts)).cast("int")
    left = probes.join(sizes, "cell").withColumn("q", slot("query_id", "q_parts")).withColumn("v", numbers("v_parts")).select("cell", "q", "v", "query_id", "embedding", "floor")
    pool = visible(index.rows, principal).join(sizes, "cell")
    right = pool.withColumn("v", slot("chunk_id", "v_parts")).withColumn("q", numbers("q_parts")).select("cell", "q", "v", "chunk_id", "embedding")
    types = [to_arrow_type(f.dataType) for f in kinds.fields]
    keys = ["cell", "q", "v"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scored(k, exclude_self, types), kinds)


def topk(queries: DataFrame, index: CellIndex, k: int, *, principal: Principal | None = None, exclude_self: bool = False) -> DataFrame:
    """The k vectors of the index with the largest products with each query: query_id, rank, chunk_id, score; exact, ties go to the smaller id.

    queries(query_id, embedding) may be of any number: both sides are dealt by cell. Each
    query first looks into the cells nearest to it, whose k-th best score rules out every
    cell that by its centre and radius cannot hold a better vector, then into the rest.
    Rows that the principal may not read are no hits. Queries without id or embedding have
    none; a query whose id is repeated is one query. Scores are rounded to twelve digits.
    """
    spark = queries.sparkSession
    ship(spark)
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", index.rows.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    held = index.cells.orderBy("cell").collect()  # at most MOST_CELLS
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    if not held:
        return spark.createDataFrame([], kinds).select("query_id", F.lit(1).cast("long").alias("rank"), "chunk_id", "score")
    known = _Cells(np.array([r["cell"] for r in held]), np.array([r["centre"] for r in held]), np.array([r["radius"] for r in held]), np.array([r["n"] for r in held]), bool(held[0]["unit"]))
    sent = spark.sparkContext.broadcast(known)
    asked = queries.where("embedding is not null and query_id is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    probe = T.StructType([kinds.fields[0], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("floor", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    least = k + exclude_self
    near = _met(asked.mapInArrow(_probes(sent, least, False, probe), probe), index, principal, k, exclude_self, kinds)
    near = written(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "near")
    floor = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    rest = asked.join(floor, "query_id", "left").select("query_id", "embedding", "floor")
    far = _met(rest.mapInArrow(_probes(sent, least, True, probe), probe), index, principal, k, exclude_self, kinds)
    both = near.drop("rank").unionByName(far).repartition("query_id")
    return both.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")

"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._store import written
from quarry.shipping import ship


def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Links (a, b) as stars: each node that is not the smallest of its component, and that smallest node."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = place[both.indices.to_numpy()].reshape(2, -1)
    root = np.arange(len(order))
    while True:
        x, y = root[ends[0]], root[ends[1]]
        if (x == y).all():
            break
        # the roots of both ends point to the smaller, then all nodes to the root that they end at
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(root)))
    return both.dictionary.take(pa.array(order[far])), both.dictionary.take(pa.array(order[root[far]]))


def _folded(flush: int):
    """Links of a task as stars of flush links at a time."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        u, v = stars(*(table.column(i).combine_chunks() if table.column(i).num_chunks != 1 else table.column(i).chunk(0) for i in range(2)))
        return pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= flush:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return run


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60, flush: int = 1 << 18) -> DataFrame:
    """node and component (its smallest node) of all nodes of links that differ from their component.

    Each task first folds its links into stars, flush links at a time, so that chains
    within a task cost no rounds and at most one link a node goes on. Then large star and
    small star rounds (Kiveris et al., 2014): each node hands its
    neighbours to the smallest of them, until the links are stars. A round is two
    grouped minima over links, with partial minima, and is written to the shared folder. A
    node may hold a third of all links, so minima are written before links meet them: as
    a file they are broadcast only if small, and else a hot node's links can be split
    over tasks. Nothing is collected. Nodes may be of any orderable type; null ends are
    ignored. A node that has no link to another node gets no row.
    """
    ship(links.sparkSession)
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    now = written(ends.mapInArrow(_folded(flush), T.StructType([T.StructField(c, ends.schema[c].dataType) for c in ("u", "v")])).distinct(), "links")
    for _ in range(max_rounds):
        # stars: each node has one smaller end at most, and one that has any is nobody's smaller end
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("below")))
        each = roles.groupBy("node").agg(F.sum("below").alias("ends"), F.min("below").alias("least"))
        if not each.agg(F.count_if((F.col("ends") > 1) | (F.col("ends") > 0) & (F.col("least") == 0))).first()[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: larger neighbours of a node link to the smallest of its neighbours and itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"no stars after {max_rounds} rounds")

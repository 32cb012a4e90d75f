"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm._store import written


def even_tree(shards: int, racks: int = 3, leaves: int = 4) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight, filled in order of shard numbers, all weights 1."""
    tree: dict[int, dict[int, dict[int, float]]] = {}
    for shard in range(shards):
        rack = shard // leaves
        tree.setdefault(rack // racks, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def grown_tree(tree: dict) -> dict:
    """tree with one more shard of weight 1, in a rack and a region of its own, so that no other subtree's weight changes."""
    racks = [rack for region in tree.values() for rack in region]
    leaves = [shard for region in tree.values() for rack in region.values() for shard in rack]
    return {**tree, max(tree, default=-1) + 1: {max(racks, default=-1) + 1: {max(leaves, default=-1) + 1: 1.0}}}


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, seed: int, level: int) -> Callable[[Column], Column]:
    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(level), child["label"]), 12)
        return F.struct((-F.ln((bits.cast("double") + 0.5) / float(1 << 52)) / child["w"]).alias("draw"), child["to"].alias("to"))

    return draw


def place(df: DataFrame, key: Column, tree: dict, name: str, seed: int = 0) -> DataFrame:
    """Add column name: the shard of each row's key, found by descending tree, nested dicts of one depth down to weights.

    At each level every child of the node reached so far draws: an exponential variate with
    the weight of the child's whole subtree as rate, from 52 bits of a hash of key, level
    and child. The child with the least draw is entered, and only its children draw next.
    So a child is entered in proportion to its weight, and a draw changes only with its own
    subtree's weight: when that grows, rows move into this child from its siblings or stay
    where they are; when it falls, they leave it. Subtrees without a change keep their rows
    among themselves. Cost is the depth times the children of a node, not the number of shards.
    """
    key_col, at_col = f"__{name}_key", f"__{name}_at"
    df = df.withColumn(key_col, key).withColumn(at_col, F.lit(0))
    nodes, level = [tree], 0
    while nodes and isinstance(nodes[0], dict):
        # at_col: number of the node reached, of those of this level
        rows, below = [], []
        for node in nodes:
            rows.append(F.array(*(F.struct(F.lit(label).cast("long").alias("label"), F.lit(_weight(child)).alias("w"), F.lit(len(below) + i).alias("to")) for i, (label, child) in enumerate(node.items()))))
            below += node.values()
        labels = [label for node in nodes for label in node]
        children = F.get(F.array(*rows), F.col(at_col)) if len(rows) > 1 else rows[0]
        df = df.withColumn(at_col, F.array_min(F.transform(children, _draw(F.col(key_col), seed, level)))["to"])
        nodes, level = below, level + 1
    return df.withColumn(name, F.get(F.array(*(F.lit(x) for x in labels)), F.col(at_col)).cast("int")).drop(key_col, at_col)


def shard_rows(
    docs: DataFrame, *, shards: int = 24, tree: dict | None = None, grown: dict | None = None, id_col: str = "doc_id",
    text_col: str = "text", seed: int = 0, rows_per_bucket: int = 50_000,
) -> DataFrame:
    """Put each row into a shard; id_col and the tree alone decide (law `key`).

    size: UTF-8 bytes of the text (null: none) plus 8. text_crc32: of the UTF-8 bytes,
    0 for a null or empty text. shard: by place(). grown_shard: with one more shard, which
    takes rows only into itself: grown_tree(), unless grown says otherwise. slot: gapless
    from 0 within the shard, by buckets of hashed rows: a bucket's rows are numbered in its
    own task, and the buckets' counts, a small table, give where each begins; so no task
    holds a whole shard, nor all rows of one id.

    Null ids are one key of their own. Repeated rows share a shard and have slots of
    their own. Returns id_col, size, text_crc32, law, shard, slot, grown_shard; other
    columns are ignored. An empty table gives an empty result. The same rows always get the
    same shards; slots also go by where rows lie in their files.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0null"))).alias("__key"),
        # rows of one id are dealt by their texts, and equal rows by where they lie
        F.xxhash64(F.col(id_col).cast("string"), text, F.spark_partition_id()).alias("__row"),
    )
    tree = tree or even_tree(shards)
    rows = place(rows, F.col("__key"), tree, "shard", seed)
    rows = place(rows, F.col("__key"), grown or grown_tree(tree), "grown_shard", seed)
    rows = written(rows.drop("__key"), "placed")  # texts are read once, and both counts below are of the same rows
    buckets = max(8, -(-rows.count() // (rows_per_bucket * shards)))
    rows = rows.withColumn("__bucket", F.pmod(F.shiftrightunsigned("__row", 8), F.lit(buckets)))
    count = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = count.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__bucket").orderBy("__row", "size", "text_crc32")
    numbered = rows.withColumn("__nth", F.row_number().over(within))
    return numbered.join(start, ["shard", "__bucket"]).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__start") + F.col("__nth") - 1).cast("long").alias("slot"), "grown_shard",
    )

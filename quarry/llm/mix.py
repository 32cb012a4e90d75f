"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm._store import written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, source_size, one row a source) with each source's target.

    Sources in order of code points, null last, get weights in turn. The targets sum to
    share times all sizes; none is above cap times its source's size, and what a capped
    source leaves is shared again by weight until none is above. That fixed point is
    min(cap * size, rate * weight) for one rate, found in order of size over weight:
    rates rise while capped sources leave the sum and fall once free ones do, so it is the
    highest rate that caps no source still counted as free. The table has a row
    for each source, so one window orders it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rate = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rated = weighed.withColumn("rate", rate).withColumn("fits", F.col("rate") * F.col("weight") <= F.col("limit"))
    last = F.max(F.when(F.col("fits"), F.col("rate"))).over(everything)
    return rated.select(*sizes.columns, F.least("limit", F.coalesce(last, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, *, group: list[str], votes: str, seats: str, name: str, order: list[Column], limit: str | None = None) -> DataFrame:
    """Sainte-Laguë: within each group, seats go to the highest quotients votes / (2 n - 1).

    parties: a row for each party, with its group's seats. Every party has floor(votes / 2x
    + 1/2) quotients of x or more, which gives at most all seats at one x and at least all at
    another. So parties get the first number at once, and only the quotients between the
    two, about two for each party, are ranked. Ties go by order. limit: a column with the
    most seats that a party may hold; what is beyond goes to the others, as far as they
    have room.
    """
    group_cols = [F.col(c) for c in group] or [F.lit(0)]
    whole = Window.partitionBy(*group_cols)
    n, total = F.count(F.lit(1)).over(whole), F.sum(votes).over(whole)
    spare = F.col(seats) - n / 2
    sure = F.when(spare > 0, F.floor(F.col(votes) * spare / total + 0.5)).otherwise(0)
    most = F.floor(F.col(votes) * (F.col(seats) + n / 2) / total + 0.5) + 1
    some = total > 0
    bounded = parties.withColumn("__sure", F.when(some, sure).otherwise(0).cast("long")).withColumn("__most", F.when(some, most).otherwise(0).cast("long"))
    bounded = bounded.withColumn("__left", F.col(seats) - F.sum("__sure").over(whole))
    more = F.filter(F.sequence(F.col("__sure"), F.col("__most")), lambda i: i > F.col("__sure"))
    quotients = bounded.withColumn("__nth", F.explode_outer(more))
    ranked = Window.partitionBy(*group_cols).orderBy((F.col(votes) / (2 * F.col("__nth") - 1)).desc_nulls_last(), *order, "__nth")
    won = quotients.withColumn("__won", F.when(F.col("__nth").isNotNull() & (F.row_number().over(ranked) <= F.col("__left")), 1).otherwise(0))
    keys = [c for c in parties.columns if c != name]
    out = won.groupBy(*keys).agg((F.first("__sure") + F.sum("__won")).cast("long").alias(name))
    if not limit:
        return out
    # seats beyond a party's limit pass to those with room, in order of their next quotients
    room = F.col(limit) - F.least(F.col(name), F.col(limit))
    spare = F.sum(F.col(name) - F.least(F.col(name), F.col(limit))).over(whole)
    next_first = Window.partitionBy(*group_cols).orderBy((F.col(votes) / (2 * F.col(name) + 1)).desc_nulls_last(), *order)
    before = F.coalesce(F.sum(room).over(next_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.least(room, spare - before), F.lit(0))
    return out.withColumn("__more", more).withColumn(name, (F.least(F.col(name), F.col(limit)) + F.col("__more")).cast("long")).drop("__more")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, cap: int = 2, block_words: int = 64, rows_per_shard: int = 2_000, seed: int = 0,
    whole_documents: bool = False, shards_per_range: int = 1_000,
) -> DataFrame:
    """How many words of each document a mix of sources takes.

    size: words of the text (null: 0). Targets: see source_targets(). Sources get words by
    Sainte-Laguë on their targets, and take them in blocks of about block_words words, or
    of a 32nd of a target that is below 32 such blocks, one word at least, so a small source
    gets its target too. Each source's blocks go to its shards (rows by hash, about
    rows_per_shard each) by Sainte-Laguë on the shards' sizes, in two steps, by ranges of
    shards_per_range shards and within these. A shard lays its documents
    end to end in hash order and cuts them into equal blocks; a quota above the number
    of blocks takes all of them once and goes on with the rest, up to cap times, and the
    remainder are the blocks with the smallest seeded hashes. taken counts a document's
    words in the blocks taken, repeats included.

    whole_documents: a shard's remainder is made up of whole documents instead, in order of
    seeded hashes, up to the one whose middle passes the words of as many blocks; so a
    shard misses its quota by half a document at most, and taken is a multiple of size.

    No task holds more than one shard's rows, one range's shards or one source's ranges, and what decides is
    hashed from the rows, so reruns agree. Null sources are a source of their own, the
    last. Rows equal in id, size and text hash are interchangeable; empty texts take
    nothing; an empty table gives an empty result; other columns are ignored.

    Returns id_col, source, size, source_size, target, taken.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("__key"),
    ).withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = written(rows, "sizes")  # texts are read once; all that follows is narrow
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    targets = source_targets(sums, weights=weights, share=share, cap=cap)
    targets = targets.withColumn("__seats", F.round(F.sum("target").over(Window.partitionBy())).cast("long"))
    quotas = apportion(targets, group=[], votes="target", seats="__seats", name="__won", order=[F.col("source").isNull(), F.col("source")])
    quotas = quotas.withColumn("__block_words", F.greatest(F.least(F.floor(F.col("target") / 32), F.lit(block_words)), F.lit(1)))
    blocks = F.greatest(F.round(F.col("source_size") / F.col("__block_words")), F.lit(1))
    quotas = quotas.withColumn("__quota", F.when(F.col("source_size") > 0, F.round(F.col("__won") * blocks / F.col("source_size"))).otherwise(0).cast("long"))
    quotas = quotas.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__s"), "source_size", "target", "__quota", "__block_words",
        F.greatest(F.ceil(F.col("__rows") / rows_per_shard), F.lit(1)).cast("long").alias("__shards"),
    )
    # a row a source: as a file its size is known, so it is broadcast only if that is small, and hot sources stay where they are
    quotas = written(quotas, "quotas")
    sourced = rows.join(quotas, "__s").withColumn("__h", F.pmod(F.shiftrightunsigned("__key", 7), F.col("__shards")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = sourced.groupBy("__s", "__h").agg(F.first("__quota").alias("__quota"), F.first("__block_words").alias("__block_words"), F.sum("size").alias("__words"))
    spread = spread.withColumn("__blocks", F.when(F.col("__words") > 0, F.greatest(F.round(F.col("__words") / F.col("__block_words")), F.lit(1))).otherwise(0).cast("long"))
    # a row a shard, which the steps below would else each make from all rows again
    spread = written(spread.withColumn("__cap", F.col("__blocks") * cap).withColumn("__range", F.floor(F.col("__h") / shards_per_range)), "shards")
    ranges = spread.groupBy("__s", "__range").agg(F.first("__quota").alias("__quota"), F.sum("__words").alias("__words"), F.sum("__cap").alias("__cap"))
    ranges = apportion(ranges, group=["__s"], votes="__words", seats="__quota", name="__seats", order=[F.col("__range")], limit="__cap").select("__s", "__range", "__seats")
    spread = apportion(spread.join(ranges, ["__s", "__range"]), group=["__s", "__range"], votes="__words", seats="__seats", name="__got", order=[F.col("__h")], limit="__cap")
    spread = spread.select(
        "__s", "__h", "__words", "__blocks",
        F.expr("if(__blocks > 0, __got div __blocks, 0)").alias("__full"), F.expr("if(__blocks > 0, __got % __blocks, 0)").alias("__rest"),
    )
    spread = written(spread, "quotas")
    shard = Window.partitionBy("__s", "__h")
    placed = sourced.join(spread, ["__s", "__h"])
    if whole_documents:
        upto = F.sum("size").over(shard.orderBy(F.xxhash64(F.lit(seed), F.lit("draw"), "__key"), "__key", "__id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        drawn = placed.withColumn("__some", F.when((F.col("__rest") > 0) & ((upto - F.col("size") / 2) * F.col("__blocks") < F.col("__rest") * F.col("__words")), F.col("size")).otherwise(0))
        taken = F.col("__full") * F.col("size") + F.col("__some")
        return drawn.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    drawn = shard.orderBy(F.xxhash64(F.lit(seed), "__s", "__h", "__block"), "__block")
    # a shard's row becomes thousands: shards are dealt to all tasks first
    blocks = spread.where("__rest > 0").repartition(parts, "__s", "__h").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    chosen = blocks.withColumn("__nth", F.row_number().over(drawn)).where("__nth <= __rest").select("__s", "__h", "__block")
    by_key = shard.orderBy("__key", "__id", "size")
    laid = placed.withColumn("__to", F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__from", F.col("__to") - F.col("size"))
    # identifies a row within its shard: rows that share a place have no words
    whole = laid.withColumn("__row", F.row_number().over(by_key)).select("__id", "source", "size", "source_size", "target", "__s", "__h", "__words", "__blocks", "__from", "__to", "__full", "__rest", "__row")
    first, last = F.expr("(__from * __blocks) div __words"), F.expr("((__to - 1) * __blocks + __blocks - 1) div __words")
    cuts = whole.where("__rest > 0 and size > 0").select("__s", "__h", "__row", "__from", "__to", "__words", "__blocks", F.explode(F.sequence(first, last)).alias("__block"))
    begin, end = F.expr("(__block * __words) div __blocks"), F.expr("((__block + 1) * __words) div __blocks")
    overlap = F.greatest(F.least(end, "__to") - F.greatest(begin, "__from"), F.lit(0))
    # blocks are many more than the shards that they are exploded from, by which the planner would judge their size
    some = cuts.join(chosen.hint("merge"), ["__s", "__h", "__block"]).groupBy("__s", "__h", "__row").agg(F.sum(overlap).alias("__some"))
    out = whole.join(some, ["__s", "__h", "__row"], "left")
    taken = F.col("__full") * F.col("size") + F.coalesce("__some", F.lit(0))
    return out.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))

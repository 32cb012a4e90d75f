"""Retrieval quality, text overlap, answer scores and paired comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions import text
from quarry.functions.vectors import cosine
from quarry.operators.answers import ungrounded_ids
from quarry.operators.bootstrap import paired_delta as paired_delta
from quarry.operators.ranks import with_rank
from quarry.shipping import ship


def first_of_each_ref(hits: DataFrame) -> DataFrame:
    """query_id, ref, rank: each reference once, at its first rank, renumbered."""
    first = hits.groupBy("query_id", "ref").agg(F.min("rank").alias("__r"))
    return first.select("query_id", "ref", F.row_number().over(Window.partitionBy("query_id").orderBy("__r", "ref")).cast("long").alias("rank"))


def ir_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, recall, precision, rr, ndcg of hits(query_id, ref, rank) against gold(query_id, ref).

    Precision counts what was returned, up to k, not k. Every query of gold gets a row;
    a query_id in gold with a null ref has no relevant reference and scores 0.
    """
    size = gold.groupBy("query_id").agg(F.countDistinct("ref").alias("n_gold"))
    return _scores(hits.where(F.col("rank") <= k).join(gold.where("ref is not null").distinct().withColumn("hit", F.lit(1)), ["query_id", "ref"], "left"), size, k)


def ir_metrics_by_topic(hits: DataFrame, asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """ir_metrics of asked(query_id, topic), to each of which the refs of its topic's other items(topic, item, ref) are relevant.

    An item whose id is the query's does not count for it. A query is asked once, about one
    topic; one whose topic has no other item gets no row. Topics are counted once and hits
    looked up in them, so nothing grows with queries times items.
    """
    held = items.where("topic is not null and ref is not null").select("topic", "item", "ref").distinct()
    refs = held.groupBy("topic", "ref").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.select("query_id", "topic").where("topic is not null").distinct()
    # refs that only the query's own item has
    mine = asked.join(held.withColumnRenamed("item", "query_id"), ["query_id", "topic"]).join(refs.where("n = 1"), ["topic", "ref"]).select("query_id", "ref", F.lit(1).alias("own"))
    size = asked.join(refs.groupBy("topic").agg(F.count(F.lit(1)).alias("all")), "topic").join(mine.groupBy("query_id").agg(F.count(F.lit(1)).alias("less")), "query_id", "left")
    size = size.select("query_id", (F.col("all") - F.coalesce("less", F.lit(0))).alias("n_gold")).where("n_gold > 0")
    marked = hits.where(F.col("rank") <= k).join(asked, "query_id").join(refs.select("topic", "ref", F.lit(1).alias("known")), ["topic", "ref"], "left").join(mine, ["query_id", "ref"], "left")
    return _scores(marked.withColumn("hit", F.when(F.col("own").isNull(), F.col("known"))), size, k)


def _scores(marked: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """Metrics of marked(query_id, ref, rank, hit) for each query of size(query_id, n_gold)."""
    per = marked.groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("hit") == 1, F.col("ref"))).alias("hits"), F.count(F.lit(1)).alias("shown"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.slice(F.array(*(F.lit(1 / math.log2(i + 1)) for i in range(1, k + 1))), F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, x: s + x)
    some = (F.col("n_gold") > 0) & F.col("shown").isNotNull()
    zero = lambda c: F.when(some, c).otherwise(F.lit(0.0))
    return size.join(per, "query_id", "left").select(
        "query_id", zero(F.col("hits") / F.col("n_gold")).alias("recall"), zero(F.col("hits") / F.col("shown")).alias("precision"),
        zero(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"), zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def macro(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over queries, zeros included, and the share of queries with a hit."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), mean("recall"), mean("precision"), mean("rr"), mean("ndcg"), F.coalesce(F.avg((F.col("rr") > 0).cast("double")), F.lit(0.0)).alias("hit_rate"))


def _clipped(orders: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, candidate tokens, reference tokens) as a row for each key and order, with clipped and whole n-gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sizes = [batch.column(i).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]
            words = pa.concat_arrays([batch.column(i).flatten() for i in (1, 2)]).dictionary_encode()
            word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.concatenate(sizes)
            text = np.repeat(np.arange(2 * rows), size)  # texts by side, then row
            left = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # words from here to the text's end
            gram, at = word, np.arange(len(word))
            out = []
            for n in range(1, orders + 1):
                if n > 1:
                    at = at[left[at] >= n]
                    _, new = np.unique(gram[at] * (len(words.dictionary) + 1) + word[at + n - 1], return_inverse=True)
                    gram = gram.copy()
                    gram[at] = new
                wide = int(gram[at].max(initial=0)) + 1
                place, inverse = np.unique(text[at] % rows * wide + gram[at], return_inverse=True)
                side = [np.bincount(inverse[x], minlength=len(place)) for x in (text[at] < rows, text[at] >= rows)]
                both = np.bincount(place // wide, weights=np.minimum(*side), minlength=rows).astype(np.int64)
                out.append((both, *(np.maximum(s - n + 1, 0) for s in sizes)))
            order = pa.array(np.repeat(np.arange(1, orders + 1), rows), pa.int32())
            columns = [pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0)] * orders), order, *columns], names=["key", "n", "both", "n_candidate", "n_reference"])

    return run


def overlaps(pairs: DataFrame, orders: int = 4) -> DataFrame:
    """pairs(key, candidate, reference) -> key, n, both, n_candidate, n_reference: clipped n-gram counts per order.

    A pair is counted where it stands, so texts never move; null texts have no tokens, and
    rows of one key are pairs of their own.
    """
    ship(pairs.sparkSession)
    tokens = pairs.select("key", *(F.coalesce(text.plain_tokens(F.col(c)), F.array().cast("array<string>")).alias(c) for c in ("candidate", "reference")))
    kinds = T.StructType([T.StructField("key", pairs.schema["key"].dataType), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("both", "n_candidate", "n_reference"))])
    return tokens.mapInArrow(_clipped(orders), kinds)


def token_f1(pairs: DataFrame) -> DataFrame:
    """key, f1 of token multisets: 1 if both texts are empty, 0 if one is."""
    o = overlaps(pairs, 1)
    p, r = F.col("both") / F.col("n_candidate"), F.col("both") / F.col("n_reference")
    f1 = F.when((F.col("n_candidate") == 0) & (F.col("n_reference") == 0), 1.0).when(F.col("both") == 0, 0.0).otherwise(2 * p * r / (p + r))
    return o.select("key", f1.alias("f1"))


def corpus_bleu(pairs: DataFrame, orders: int = 4, floor: float = 1e-9) -> DataFrame:
    """One row: BLEU over the whole set, clipped counts summed first, with brevity penalty; 0 if an order has no n-gram."""
    sums = overlaps(pairs, orders).groupBy("n").agg(F.sum("both").alias("both"), F.sum("n_candidate").alias("c"), F.sum("n_reference").alias("r"))
    part = F.when(F.col("c") > 0, F.log(F.greatest(F.col("both") / F.col("c"), F.lit(floor))))
    one = sums.agg(F.sum(part).alias("logs"), F.count(part).alias("orders"), F.max(F.when(F.col("n") == 1, F.col("c"))).alias("c"), F.max(F.when(F.col("n") == 1, F.col("r"))).alias("r"))
    brevity = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return one.select(F.when((F.coalesce(F.col("orders"), F.lit(0)) < orders) | (F.coalesce(F.col("c"), F.lit(0)) == 0), 0.0).otherwise(brevity * F.exp(F.col("logs") / orders)).alias("bleu"))


def secrets(rows: DataFrame) -> DataFrame:
    """rows(text, secret_terms, reconstruction) with n_secret, n_recovered, fully_leaked (all of one or more)."""
    # lowered in an array of one, so once a text and not once a term
    low = F.array(F.lower("reconstruction"))
    found = F.flatten(F.transform(low, lambda x: F.filter("secret_terms", lambda t: F.contains(x, F.lower(t)))))
    return rows.withColumn("n_secret", F.size("secret_terms")).withColumn("n_recovered", F.size(found)).withColumn("fully_leaked", (F.col("n_secret") > 0) & (F.col("n_recovered") == F.col("n_secret")))


def group_scores(scored: DataFrame) -> DataFrame:
    """Overall, by source_type and by tlp: n, exact, f1, cosine, secrets recovered and fully leaked; one pass by grouping sets."""
    grouped = scored.groupingSets([[], ["source_type"], ["tlp"]], "source_type", "tlp")
    secret = F.when(F.sum("n_secret") > 0, F.sum("n_recovered") / F.sum("n_secret")).otherwise(0.0)
    return grouped.agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg("f1").alias("f1"), F.avg("cosine").alias("cosine"),
        secret.alias("secret_recovery"), F.sum(F.col("fully_leaked").cast("long")).alias("fully_leaked"),
    )


def score_reconstructions(truth: DataFrame, rebuilt: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-chunk scores of truth(chunk_id, text, secret_terms, source_type, tlp) against rebuilt(chunk_id, reconstruction), and the ids without a counterpart.

    vectors(chunk_id, original, round_trip) adds the cosine, null where missing. Null reconstructions were not produced and are left out.
    """
    made = rebuilt.where("reconstruction is not null")
    both = truth.join(made, "chunk_id")
    f1 = token_f1(both.select(F.col("chunk_id").alias("key"), F.col("reconstruction").alias("candidate"), F.col("text").alias("reference"))).withColumnRenamed("key", "chunk_id")
    both = secrets(both.join(f1, "chunk_id")).withColumn("exact", text.strip(F.col("text")) == text.strip(F.col("reconstruction")))
    near = F.lit(None).cast("double")
    if vectors is not None:
        both, near = both.join(vectors, "chunk_id", "left"), cosine(F.col("original"), F.col("round_trip"))
        near = F.when(F.col("original").isNotNull() & F.col("round_trip").isNotNull(), near)
    unmatched = made.select("chunk_id").join(truth, "chunk_id", "left_anti").orderBy("chunk_id")
    return both.withColumn("cosine", near), unmatched


def finding_rule(deltas: DataFrame, *by: str) -> DataFrame:
    """higher or lower only where every baseline repeat's interval excludes zero on that side; else unresolved."""
    verdict = F.when(F.bool_and(F.col("low") > 0), "higher").when(F.bool_and(F.col("high") < 0), "lower").otherwise("unresolved")
    return deltas.groupBy(*by).agg(F.min("mean_delta").alias("delta_low"), F.max("mean_delta").alias("delta_high"), verdict.alias("finding"))


def answer_scores(answers: DataFrame, *by: str) -> DataFrame:
    """answers(refused, text, relevant, evidence, unsupported) by group: on_target, refusal and recall rates, shares of ungrounded ids and unsupported citations."""
    rows = answers.withColumn("named", F.filter("relevant", lambda r: F.contains(F.col("text"), r))).withColumn("ids", text.technique_ids(F.col("text")))
    rows = rows.withColumn("loose", ungrounded_ids(F.col("text"), F.col("evidence")))
    hit = (~F.col("refused")) & (F.size("named") > 0)
    recall = F.when(F.col("refused") | (F.size("relevant") == 0), 0.0).otherwise(F.size("named") / F.size("relevant"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("on_target"), F.avg(F.col("refused").cast("double")).alias("refusal_rate"), F.avg(recall).alias("answer_recall"),
        F.when(F.sum(F.size("ids")) > 0, F.sum(F.size("loose")) / F.sum(F.size("ids"))).otherwise(0.0).alias("ungrounded_rate"),
        F.avg((F.size("unsupported") > 0).cast("double")).alias("unsupported_rate"),
    )


def length_terciles(rows: DataFrame) -> DataFrame:
    """rows(model, question_id, chars, hit): thirds by length in order, the last with the remainder: tercile, n, mean, median, hit rate.

    Ranks come from ranges, and a third's median from the rows of its middle ranks, so no
    task holds a model.
    """
    numbered = with_rank(rows.select("model", "question_id", "chars", "hit"), "model", "chars", "question_id", rank="__i", size="__n")
    third = F.floor(F.col("__n") / 3)
    tercile = F.least(F.when(third > 0, F.floor((F.col("__i") - 1) / third)).otherwise(2), F.lit(2)).cast("long")
    start = F.when(third > 0, F.col("tercile") * third).otherwise(0)
    size = F.when((third > 0) & (F.col("tercile") < 2), third).otherwise(F.col("__n") - start)
    # the middle ranks of a third; one if its size is odd
    middle = F.col("__i").isin(F.floor((size + 1) / 2) + start, F.floor((size + 2) / 2) + start)
    return numbered.withColumn("tercile", tercile).groupBy("model", "tercile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("chars").alias("mean_chars"), F.avg(F.when(middle, F.col("chars"))).alias("median_chars"), F.avg(F.col("hit").cast("double")).alias("hit_rate"),
    )

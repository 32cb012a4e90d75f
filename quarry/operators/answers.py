"""From ranked hits to audited answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text

# Fixed value: the answer where nothing was retrieved.
NO_EVIDENCE = "No indexed material matched this question, so there is nothing to answer from."


def citation(ref: Column, title: Column) -> Column:
    return F.concat_ws(" — ", ref, title)


def within_budget(hits: DataFrame, max_chars: int) -> DataFrame:
    """hits(query_id, rank, citation, text) with block, up to the first whose block passes the budget; the first always stays, blank lines between count nothing."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "citation", F.lit("\n"), text.strip(F.col("text")))
    rows = hits.withColumn("block", block)
    used = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("used", used).where((F.col("used") <= max_chars) | (F.col("rank") == 1))


def format_context(hits: DataFrame, max_chars: int = 6000) -> DataFrame:
    """query_id, context: numbered blocks in order of rank; lengths only grow, so what fits is a prefix."""
    kept = within_budget(hits, max_chars).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return kept.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def resolve_citations(answers: DataFrame) -> DataFrame:
    """answers(text, retrieved: array of structs with citation) with citations and unsupported markers, both distinct and in order.

    Markers count all retrieved passages, also those that the context had no room for.
    """
    marks = F.regexp_extract_all("text", F.lit(text.MARKER), F.lit(1))
    good = lambda m: (m.cast("int") >= 1) & (m.cast("int") <= F.size("retrieved"))
    cited = F.transform(F.filter(marks, good), lambda m: F.get(F.col("retrieved"), m.cast("int") - 1)["citation"])
    loose = F.transform(F.filter(marks, lambda m: ~good(m)), lambda m: F.concat(F.lit("["), m, F.lit("]")))
    return answers.withColumn("citations", F.array_distinct(cited)).withColumn("unsupported", F.array_distinct(loose))


def extractive(question: Column, context: Column) -> Column:
    """A generator without a model: the first line of the first passage, cited."""
    return F.concat(F.get(F.split(context, "\n"), F.lit(1)), F.lit(" [1]."))


def answer(questions: DataFrame, hits: DataFrame, *, max_chars: int = 6000, generate: Callable[[Column, Column], Column] = extractive, rules: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
    """questions(query_id, question) answered from hits(query_id, rank, citation, source_ref, title, text, trust_tier).

    A question without hits gets NO_EVIDENCE and the generator is not asked. rules run on
    the answers in the order given.
    """
    passage = F.struct("rank", "citation", "source_ref", "title", "text", "trust_tier")
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(passage)).alias("retrieved"))
    rows = questions.join(got, "query_id", "left").join(format_context(hits, max_chars), "query_id", "left")
    said = F.when(F.col("retrieved").isNull(), F.lit(NO_EVIDENCE)).otherwise(generate(F.col("question"), F.col("context")))
    empty = "array<struct<rank:bigint,citation:string,source_ref:string,title:string,text:string,trust_tier:int>>"
    rows = rows.withColumn("text", said).withColumn("retrieved", F.coalesce("retrieved", F.array().cast(empty)))
    none = F.array().cast("array<string>")
    rows = resolve_citations(rows).withColumns({"stripped_urls": none, "abstained": none, "blocked": F.lit(False), "block_reason": F.lit(None).cast("string")})
    for rule in rules:
        rows = rule(rows)
    return rows


def evidence_ids(retrieved: Column) -> Column:
    """References of passages and technique ids in their titles and texts."""
    return F.array_distinct(F.flatten(F.transform(retrieved, lambda h: F.concat(F.array(h["source_ref"]), text.technique_ids(h["title"]), text.technique_ids(h["text"])))))


def ungrounded_ids(said: Column, evidence: Column) -> Column:
    """Technique ids of an answer that no passage has; a passage on a sub-technique grounds its parent, not the reverse."""
    return F.filter(text.technique_ids(said), lambda i: ~F.exists(evidence, lambda e: (e == i) | F.startswith(e, F.concat(i, F.lit(".")))))

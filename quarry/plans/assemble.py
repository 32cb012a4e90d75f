"""From settings to answers: sources in order, rules, chunks, a collection, and questions to it."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.vectors import hashed_embedding, normalised
from quarry.operators import access, answers, chunking, redteam, rules, search, store
from quarry.operators.words import WordIndex
from quarry.plans.config import Config
from quarry.scratch import written

# Public sources come before restricted ones, so that an ingest cut short leaves what is public.
SOURCE_ORDER = ("attack_cti", "nvd_cve", "vendor_report", "internal_notes")
VECTOR = "main"
DIMENSIONS = 64


def embedded(said: Column) -> Column:
    """The embedder that is used if no other is named."""
    return hashed_embedding(text.plain_tokens(said), DIMENSIONS)


def enabled_rules(config: Config) -> rules.Enabled:
    r = config.rules
    return rules.enabled(r.enabled, cap=r.source_cap, fence_tier=r.fence_tier, allowed_hosts=tuple(r.allowed_hosts))


def documents(enabled: Iterable[str], builders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The documents of all enabled sources, in SOURCE_ORDER; a source that is not known or has no builder is an error."""
    wanted = set(enabled)
    if unknown := sorted(wanted - set(SOURCE_ORDER) | wanted - set(builders)):
        raise KeyError(f"unknown sources {unknown}; have {[x for x in SOURCE_ORDER if x in builders]}")
    if not wanted:
        raise ValueError("no source is enabled")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (builders[x]() for x in SOURCE_ORDER if x in wanted))


def ingest(docs: DataFrame, config: Config, *, embed: Callable[[Column], Column] = embedded, dimensions: int = DIMENSIONS) -> tuple[store.Collection | store.Segregated, DataFrame]:
    """A collection of documents(id, title, text, source_type, source_ref, tlp, trust_tier), and what the rules let in.

    Nothing runs yet: write a collection and open it again before asking often.
    """
    on = enabled_rules(config)
    judged = rules.admit(docs, on.documents)
    kept = judged.where("rejected_by is null").drop("rejected_by").withColumn("tlp_rank", access.tlp_rank(F.col("tlp")))
    chunks = chunking.chunk(kept, config.chunking.strategy, config.chunking.size, config.chunking.overlap)
    vectors = chunks.select("chunk_id", F.lit(VECTOR).alias("vector_name"), normalised(embed(F.col("text"))).alias("embedding"))
    held = store.Collection(chunks, vectors, {VECTOR: dimensions})
    if config.retrieval.mode == "hybrid":
        return held.with_postings(), rules.ingest_stats(judged)
    return (store.segregated(held, config.rules.restrict_above) if on.segregated else held), rules.ingest_stats(judged)


def ask(
    held: store.Collection | store.Segregated, questions: DataFrame, config: Config, principal: access.Principal | None, *,
    embed: Callable[[Column], Column] = embedded, generate: Callable[[Column, Column], Column] = answers.extractive,
) -> DataFrame:
    """questions(query_id, question) answered from what the principal may read, under the rules on hits and answers."""
    on, r = enabled_rules(config), config.retrieval
    queries = questions.withColumn("embedding", embed(F.coalesce("question", F.lit(""))))
    found = lambda depth: held.search(queries, VECTOR, depth, principal=principal, mode=r.mode, prefetch=r.prefetch)
    hits = search.retrieve(found, held.chunks, k=r.top_k, overfetch=r.overfetch, score_threshold=r.score_threshold, hybrid=r.mode == "hybrid", principal=principal, rules=on.hits)
    cited = hits.withColumn("citation", answers.citation(F.col("source_ref"), F.col("title")))
    return answers.answer(questions, cited, max_chars=config.max_context_chars, generate=generate, rules=on.answers)


def run_attacks(
    attacks: DataFrame, chunks: DataFrame, config: Config, sink: str, *, index: WordIndex | None = None, vectors: DataFrame | None = None,
    embed: Callable[[Column], Column] = embedded, generate: Callable[[Column, Column], Column] = answers.extractive,
) -> DataFrame:
    """attack_id, landed, criteria, abstained, refs: each attack(id, target_query, clearance, doc, success) on the collection as if its document alone had been added.

    Nothing is added, so nothing is left behind. A document that the rules on documents
    reject is not there; its question is asked all the same. Attacks ask with their own
    clearance, null meaning clear, and an unknown one is refused; the collection is searched
    once for each clearance that occurs, four times at most. Settings say which rules are
    on, index and vectors what is searched.
    """
    on, r = enabled_rules(config), config.retrieval
    c = config.chunking
    cases = attacks.withColumn("clearance", F.lower(F.coalesce("clearance", F.lit("clear"))))
    if unknown := sorted(x[0] for x in cases.where(~F.col("clearance").isin(*access.TLP)).select("clearance").distinct().limit(5).collect()):
        raise ValueError(f"unknown clearances {unknown}")
    poison = written(redteam.poison_chunks(attacks, sink, screens=on.documents, strategy=c.strategy, size=c.size, overlap=c.overlap), "poison")
    seen = chunks.unionByName(poison.drop("attack_id"), allowMissingColumns=True)
    said = []
    for tlp in (x for x in access.TLP if not cases.where(F.col("clearance") == x).isEmpty()):
        who = access.Principal("attacked", clearance=tlp)
        asked = cases.where(F.col("clearance") == tlp).select(F.col("id").alias("query_id"), F.col("target_query").alias("question"))
        queries = asked if vectors is None else asked.withColumn("embedding", embed(F.coalesce("question", F.lit(""))))
        found = functools.partial(redteam.overlay_topk, queries, chunks, poison, index=index, vectors=vectors, principal=who, embed=embed, prefetch=r.prefetch)
        hits = search.retrieve(found, seen, k=r.top_k, overfetch=r.overfetch, score_threshold=r.score_threshold, hybrid=r.mode == "hybrid", principal=who, rules=on.hits)
        cited = hits.withColumn("citation", answers.citation(F.col("source_ref"), F.col("title")))
        said.append(answers.answer(asked, cited, max_chars=config.max_context_chars, generate=generate, rules=on.answers))
    if not said:
        return attacks.sparkSession.createDataFrame([], "attack_id string, landed boolean, criteria array<struct<type:string,value:string,passed:boolean>>, abstained array<string>, refs array<string>")
    every = functools.reduce(DataFrame.unionByName, said)
    runs = redteam.fired(every.select(F.col("query_id").alias("attack_id"), "text", "abstained", F.transform("retrieved", lambda h: h["source_ref"]).alias("refs")), sink)
    runs = written(runs, "attacked")
    return redteam.verdicts(cases, runs).join(runs.select("attack_id", "abstained", "refs"), "attack_id")

"""Questions with known answers, identifier probes, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.ranks import smallest

TITLE = r"^(\S+) (.+) \((technique|group|software)\)$"
CVE_REF = r"^CVE-\d{4}-\d{4,}$"


def by_hash(key: Column, seed: int) -> Column:
    """A seeded order that no partitioning changes."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def gold_set(edges: DataFrame, *, least: int = 3, most: int = 8, limit: int | None = 200, seed: int = 1337) -> DataFrame:
    """edges(group_id, group_name, tactic, technique) -> id, question, relevant, tags: pairs of group and tactic with least to most techniques, limit of them by seeded hash (None: all)."""
    pairs = edges.where(F.coalesce(F.col("tactic"), F.lit("unspecified")) != "unspecified").groupBy("group_id", "tactic").agg(F.first("group_name").alias("name"), F.array_sort(F.collect_set("technique")).alias("relevant"))
    kept = pairs.where(F.size("relevant").between(least, most)).withColumn("id", F.concat_ws(":", "group_id", "tactic"))
    asked = F.concat(F.lit("Which "), F.translate("tactic", "-", " "), F.lit(" techniques does "), "name", F.lit(" use?"))
    tags = F.create_map(F.lit("group"), F.col("group_id").cast("string"), F.lit("group_name"), F.col("name").cast("string"), F.lit("tactic"), F.col("tactic"))
    kept = kept if limit is None else kept.orderBy(by_hash(F.col("id"), seed), "id").limit(limit)
    return kept.select("id", asked.alias("question"), "relevant", tags.alias("tags"))


def gold_refs(gold: DataFrame) -> DataFrame:
    return gold.select(F.explode("relevant").alias("ref")).distinct()


def identifier_probes(docs: DataFrame, *, per_kind: int = 150, seed: int = 1337) -> DataFrame:
    """docs(source_ref, title): documents asked for by id and by name, names that one reference alone owns; CVEs by id only."""
    seen = docs.select("source_ref", "title").distinct()
    part = lambda i: F.regexp_extract("title", TITLE, i)
    named = seen.select("source_ref", part(1).alias("ref"), part(2).alias("name"), part(3).alias("kind")).where("kind <> '' and ref = source_ref").select("source_ref", "name", "kind").distinct()
    owners = named.groupBy(F.lower("name").alias("key")).agg(F.countDistinct("source_ref").alias("owners"))
    clear = named.join(owners, F.lower("name") == F.col("key")).where("owners = 1").select("source_ref", "name", "kind")
    cves = seen.where(F.col("source_ref").rlike(CVE_REF) & ~(part(1) == F.col("source_ref"))).select("source_ref", F.lit(None).cast("string").alias("name"), F.lit("cve").alias("kind")).distinct()
    order = Window.partitionBy("kind").orderBy(by_hash(F.col("source_ref"), seed), "source_ref", "name")
    picked = clear.unionByName(cves).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_kind)
    ask = lambda phrasing, what: F.struct(F.lit(phrasing).alias("phrasing"), F.concat(F.lit("What is "), what, F.lit("?")).alias("question"))
    both = F.filter(F.array(ask("id", F.col("source_ref")), ask("name", F.col("name"))), lambda x: x["question"].isNotNull())
    rows = picked.withColumn("p", F.explode(both))
    return rows.select(F.concat_ws(":", "source_ref", "p.phrasing").alias("id"), "p.question", F.array("source_ref").alias("relevant"), "kind", "p.phrasing")


def quotas(counts: DataFrame, total: int) -> DataFrame:
    """counts(source_type, n) with seats: floors of the shares, clamped, then one more each by largest remainder, then size."""
    whole = Window.partitionBy()
    exact = F.lit(float(total)) * F.col("n") / F.sum("n").over(whole)
    rows = counts.withColumn("exact", F.when(F.sum("n").over(whole) > 0, exact).otherwise(0.0)).withColumn("floor", F.least(F.floor("exact"), F.col("n")))
    rows = rows.withColumn("left", F.lit(total) - F.sum("floor").over(whole)).withColumn("open", F.col("floor") < F.col("n"))
    order = Window.partitionBy("open").orderBy(F.desc(F.col("exact") - F.floor("exact")), F.desc("n"), "source_type")
    extra = F.when(F.col("open") & (F.row_number().over(order) <= F.col("left")), 1).otherwise(0)
    return rows.select("source_type", "n", (F.col("floor") + extra).cast("long").alias("seats"))


def stratified_sample(chunks: DataFrame, total: int, *, seed: int, census: tuple[str, ...] = ("internal_note",), excluded: tuple[str, ...] = ("synthetic_adversarial",)) -> DataFrame:
    """All chunks of the census corpora, none of the excluded, and of the others total by quota, the smallest seeded hashes of each; by chunk id."""
    rest = chunks.where(~F.col("source_type").isin(*census, *excluded))
    seats = quotas(rest.groupBy("source_type").agg(F.count(F.lit(1)).alias("n")), total).select("source_type", "seats")
    taken = smallest(rest, seats.withColumnRenamed("seats", "take"), "source_type", by_hash(F.col("chunk_id"), seed), "chunk_id").select(*chunks.columns)
    return chunks.where(F.col("source_type").isin(*census)).unionByName(taken).orderBy("chunk_id")


def secret_terms(chunks: DataFrame, terms: str = "terms") -> DataFrame:
    """chunks with secret_terms: its reference and named terms, distinct, as far as its text has them in any case."""
    every = F.array_distinct(F.concat(F.array("source_ref"), F.coalesce(F.col(terms), F.array().cast("array<string>"))))
    return chunks.withColumn("secret_terms", F.filter(every, lambda t: (t != "") & F.contains(F.lower("text"), F.lower(t))))


def save_gold(gold: DataFrame, path: str) -> None:
    gold.coalesce(1).write.mode("overwrite").json(path)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, relevant array<string>, tags map<string,string>").json(path)

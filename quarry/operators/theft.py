"""What stolen vectors give away: re-identification, reconstruction, and the bundles that carry them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions import text
from quarry.functions.vectors import normalised
from quarry.operators import chunking, search, seals

PARTS = ("vectors", "truth")


def build_reference(docs: DataFrame, embed: Callable[[Column], Column], *, passage_chars: int | None = None) -> DataFrame:
    """What an outsider can embed of public documents(id, source_ref, title, text): ref_id, doc_id, source_ref, title, embedding at unit length.

    Whole documents, or with passage_chars their passages of that many characters, each of
    them its document's; a document without words then has no row.
    """
    told = docs.select(F.col("id").alias("doc_id"), "source_ref", "title", F.coalesce("text", F.lit("")).alias("text"))
    if passage_chars is None:
        rows = told.withColumn("ref_id", F.col("doc_id").cast("string"))
    else:
        parts = chunking.passage_rows(told, passage_chars, keep=("source_ref", "title"))
        rows = parts.withColumn("ref_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("passage").cast("string")))
    return rows.select("ref_id", "doc_id", "source_ref", "title", normalised(embed(F.col("text"))).alias("embedding"))


def dump(rows: DataFrame, path: str) -> None:
    """Re-identified rows as JSON lines, without the chunks' texts."""
    rows.drop("text").write.mode("overwrite").json(path)


def nearest(stolen: DataFrame, reference: DataFrame, *, block: int = 2048) -> DataFrame:
    """chunk_id, ref_id, score: the reference vector nearest each stolen one by cosine; ties go to the smaller ref_id.

    Up to block stolen vectors are sent to the reference, which then never moves; more of
    them meet it in cells, so both tables may be of any size.
    """
    hits = search.dense_topk(stolen.select(F.col("chunk_id").alias("query_id"), "embedding"), reference.select(F.col("ref_id").alias("chunk_id"), "embedding"), 1, cosine=True, block=block)
    return hits.select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("ref_id"), "score")


def reidentify(stolen: DataFrame, reference: DataFrame) -> DataFrame:
    """Per stolen chunk (chunk_id, doc_id, source_type, text): the predicted document and whether document, topic or reference were right.

    reference(ref_id, doc_id, source_ref, title, embedding). correct: the own document is
    in the reference and was found. topic_hit: a content word of the predicted title is a
    token of the text; ref_hit: the text holds the predicted reference.
    """
    known = reference.select("ref_id", F.col("doc_id").alias("predicted_doc_id"), F.col("source_ref").alias("predicted_ref"), F.col("title").alias("predicted_title"))
    docs = reference.select("doc_id").distinct().withColumn("in_reference", F.lit(True))
    rows = stolen.drop("embedding").join(nearest(stolen, reference), "chunk_id").join(known, "ref_id").join(docs, "doc_id", "left")
    topic = F.arrays_overlap(text.topic_terms(F.col("predicted_title"), F.col("predicted_ref")), text.plain_tokens(F.col("text")))
    return rows.withColumns({
        "in_reference": F.coalesce("in_reference", F.lit(False)), "correct": F.col("doc_id") == F.col("predicted_doc_id"), "topic_hit": F.coalesce(topic, F.lit(False)),
        "ref_hit": (F.col("predicted_ref") != "") & F.contains(F.lower("text"), F.lower("predicted_ref")),
    })


def report(rows: DataFrame) -> DataFrame:
    """Overall and by source_type: recognised of recognisable, topic and reference hits of hidden."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    known, hidden = F.col("in_reference"), ~F.col("in_reference")
    return rows.rollup("source_type").agg(
        F.grouping_id().alias("level"), count(known)("recognisable"), count(known & F.col("correct"))("recognised"), count(hidden)("hidden"),
        count(hidden & F.col("topic_hit"))("topic_hits"), count(hidden & F.col("ref_hit"))("ref_hits"),
    )


def export_bundle(sample: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """Write vectors (to share) and truth (never) apart, and a manifest; returns the ids without a vector."""
    unit = vectors.withColumn("embedding", normalised(F.col("embedding")))
    sample.select("chunk_id").join(unit, "chunk_id").select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    sample.drop("embedding").write.mode("overwrite").parquet(f"{path}/truth")
    write_manifest(sample.sparkSession, path)
    return sample.select("chunk_id").join(vectors, "chunk_id", "left_anti").orderBy("chunk_id")


def control_truth(sample: DataFrame, tokens: int) -> DataFrame:
    """The answer key cut to a text's first tokens, its secrets to those still in it."""
    head = F.array_join(F.slice(F.split("text", r"\s+"), 1, tokens), " ")
    return sample.withColumn("text", head).withColumn("secret_terms", F.filter("secret_terms", lambda t: F.contains(F.lower("text"), F.lower(t))))


def export_control(sample: DataFrame, path: str, tokens: int, embed: Callable[[Column], Column]) -> None:
    """The bundle of what an inversion could give back at best: texts cut to their first tokens, and the vectors of these cut texts."""
    truth = control_truth(sample.drop("embedding"), tokens)
    truth.write.mode("overwrite").parquet(f"{path}/truth")
    truth.select("chunk_id", normalised(embed(F.col("text"))).alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")
    write_manifest(sample.sparkSession, path)


def write_manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, rows, root of a bundle's parts, as JSON beside their seals: what was written is read again for it."""
    made = []
    for part in PARTS:
        rows = spark.read.parquet(f"{path}/{part}")
        made.append((part, rows.count(), seals.seal(rows, "chunk_id", f"{path}/seals/{part}")))
    manifest = spark.createDataFrame(made, "part string, rows long, root string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")  # two rows
    return manifest


def altered(spark: SparkSession, path: str) -> DataFrame:
    """part, node, sealed, found, keys: what of a bundle is not as its manifest says; see seals.altered(). A bundle whose truth was held back is checked without it."""
    out = None
    for part, root in sorted((r.part, r.root) for r in spark.read.schema("part string, rows long, root string").json(f"{path}/manifest").collect()):  # two rows
        try:
            rows = spark.read.parquet(f"{path}/{part}")
        except AnalysisException as e:
            if part == "truth" and e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        found = seals.altered(rows, "chunk_id", f"{path}/seals/{part}", proof=root).select(F.lit(part).alias("part"), "node", "sealed", "found", F.col("keys").cast("array<string>").alias("keys"))
        out = found if out is None else out.unionByName(found)
    return out


def load_reconstructions(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, reconstruction of a JSON-lines file: nulls were not produced, of repeated ids the last line counts."""
    rows = spark.read.schema("chunk_id string, reconstruction string").json(path).withColumn("__n", F.monotonically_increasing_id()).where("reconstruction is not null")
    last = Window.partitionBy("chunk_id").orderBy(F.desc("__n"))
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").select("chunk_id", "reconstruction")


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/truth")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])).parquet(f"{path}/vectors")

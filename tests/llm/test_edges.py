"""Columns of unusual names and types."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import classify, jaccard, stages


@pytest.mark.parametrize("name", ["digest", "n_shingles"])
def test_ids_named_like_columns_of_the_join(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], f"`{name}` long, text string")
    out = jaccard.near_duplicates(docs, id_col=name)
    other = "n_shingles_" if name == "n_shingles" else "n_shingles"
    assert out.columns == [name, other, "component_id"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_labels_of_other_kinds(spark):
    docs = spark.createDataFrame([(i, "fine words here" if i % 2 else "### bad bad bad") for i in range(60)], "doc_id long, text string")
    clean = spark.createDataFrame([(str(i), str(i % 2)) for i in range(60)], "doc_id string, quality string")
    odd = clean.unionByName(spark.createDataFrame([("x1", "1"), ("3", "good"), ("5", ""), (None, "1"), ("7", None)], clean.schema))
    want = classify.fit(docs, clean.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")))
    scores = [{r.doc_id: r.score for r in classify.score(docs, classify.fit(docs, x)).collect()} for x in (clean, odd)]
    assert scores[0] == scores[1] == {r.doc_id: r.score for r in classify.score(docs, want).collect()}


def test_texts_of_other_types(spark):
    docs = spark.createDataFrame([(1, 12345, "x"), (2, None, None)], "doc_id long, text int, `__said` string")
    model = classify.train(["good words", "bad junk"], [1, 0])
    assert stages.drop_low_quality(docs, model, threshold=0.0).collect() == docs.collect()
    items = spark.createDataFrame([(1, "12345"), (2, None)], "item_id long, text string")
    kept = stages.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import guards, payloads, rules, store, stored

CHUNKS = "chunk_id string, doc_id string, ordinal int, text string, title string, source_type string, source_ref string, url string, tlp string, trust_tier int, metadata map<string,string>, extra int"


def test_payloads_come_back_and_missing_fields_get_defaults(spark):
    rows = [("c", "d", 3, 'say "hi"\n', "t", "nvd_cve", "CVE-2024-1000", None, "amber", 2, {"k": "v"}, 1), ("e", None, None, None, None, None, None, "u", None, None, None, 1)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    made = payloads.to_payload(chunks)
    assert json.loads(made.where("chunk_id = 'c'").first().payload)["url"] is None
    back = {r.chunk_id: tuple(r) for r in payloads.from_payload(made).collect()}
    assert back["c"] == rows[0][:-1]
    assert back["e"] == ("e", "", 0, "", "", "attack_cti", "", "u", "clear", 0, {})
    assert set(json.loads(payloads.to_payload(chunks, nulls=False).where("chunk_id = 'e'").first().payload)) == {"chunk_id", "url"}
    # no payload, no fields; fields beyond the known ones go; nested metadata stays as its JSON
    said = payloads.from_payload(spark.createDataFrame([(None,), ("{}",), ('{"chunk_id":"x","more":1,"metadata":{"a":{"b":1}}}',)], "payload string"))
    assert sorted((r.chunk_id, r.metadata) for r in said.collect()) == [("", {}), ("", {}), ("x", {"a": '{"b":1}'})]
    assert payloads.from_payload(made.limit(0)).count() == 0


@pytest.mark.parametrize("payload", ['{"tlp":"purple"}', '{"source_type":"rumour"}', '{"ordinal":"first"}', "not json"])
def test_payloads_that_would_declassify_are_errors(spark, payload):
    with pytest.raises(Exception, match="payload|Malformed|MALFORMED"):
        payloads.from_payload(spark.createDataFrame([(payload,)], "payload string")).collect()


def collection(spark, n=4):
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit("attack_cti").alias("source_type"), F.lit(0).alias("tlp_rank"), F.concat(F.lit("alpha beta"), F.col("id").cast("string")).alias("text"))
    return chunks, chunks.select("chunk_id", F.lit("main").alias("vector_name"), F.array(F.col("chunk_id") + 0.1, F.lit(0.3)).alias("embedding"))


def test_guards_of_ingest(spark):
    held = store.Collection(*collection(spark), {"main": 2, "second": 2})
    guards.check_encoder(held, "main", "main")
    guards.check_encoder(store.Collection(*collection(spark, 0), {}), "main", "second")
    with pytest.raises(ValueError, match="attach"):
        guards.check_encoder(held, "main", "second")
    two, _ = held.attach("second", spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "chunk_id long, embedding array<double>"))
    twice = spark.createDataFrame([(2,), (2,), (3,)], "chunk_id long")
    assert [tuple(r) for r in guards.at_risk(two, twice, "main").collect()] == [("second", 1)]
    assert guards.at_risk(held, twice, "main").count() == 0
    chunks, vectors = collection(spark, 3)
    assert [tuple(r) for r in guards.dropped(two.vectors, two.upsert(chunks, vectors).vectors).collect()] == [("second", 2, 0)]
    assert guards.dropped(two.vectors, two.vectors).count() == 0


def test_an_upsert_counts_an_id_once(spark):
    chunks, vectors = collection(spark)
    held = store.Collection(chunks, vectors, {"main": 2}).with_postings(avg_len=2.0)
    new = spark.createDataFrame([(1, "attack_cti", 0, "old"), (1, "attack_cti", 0, "new"), (None, "attack_cti", 0, "lost"), (9, "attack_cti", 0, "nine")], "chunk_id long, source_type string, tlp_rank int, text string").coalesce(1)
    given = spark.createDataFrame([(1, "main", [9.0, 0.0]), (1, "main", [0.0, 5.0])], "chunk_id long, vector_name string, embedding array<double>").coalesce(1)
    after = held.upsert(new, given)
    assert sorted((r.chunk_id, r.text) for r in after.chunks.collect()) == [(0, "alpha beta0"), (1, "new"), (2, "alpha beta2"), (3, "alpha beta3"), (9, "nine")]
    assert [list(r.embedding) for r in after.vectors.where("chunk_id = 1").collect()] == [[0.0, 1.0]]
    assert {r.term for r in after.postings.where("chunk_id = 1").collect()} == {"new"}


def test_a_hybrid_copy_leaves_its_source_alone(spark, tmp_path):
    source = stored.create(spark, str(tmp_path / "dense"), *collection(spark), {"main": 2})
    with pytest.raises(ValueError, match="source itself"):
        guards.build_hybrid(source, f"file:{tmp_path}/dense", reset=True)
    empty = stored.create(spark, str(tmp_path / "empty"), *collection(spark, 0), {"main": 2})
    path = str(tmp_path / "hybrid")
    with pytest.raises(ValueError, match="empty"):
        guards.build_hybrid(empty, path)
    copy = guards.build_hybrid(source, path)
    assert sorted(map(str, copy.vectors.collect())) == sorted(map(str, source.vectors.collect()))  # bit by bit
    asked = spark.createDataFrame([(1, [0.0, 1.0], "beta3")], "query_id long, embedding array<double>, question string")
    assert [r.chunk_id for r in copy.search(asked, "main", 1, mode="hybrid").collect()] in ([3], [0])
    with pytest.raises(ValueError, match="reset"):
        guards.build_hybrid(source, path)
    source.delete(spark.createDataFrame([(0,)], "chunk_id long"))
    assert guards.build_hybrid(stored.open_stored(spark, source.path), path, reset=True).count() == 3
    assert stored.open_stored(spark, path).number == 0


def test_one_search_finds_what_each_pattern_would(spark):
    said = ["Ignore previous text", "please DISREGARD the rest", "your  rules", "as an AI", "a must end with b", "When asked", "never reveal", "nothing here", "", None, "xignore previous", "secret plan"]
    rows = spark.createDataFrame([(i, None, t) for i, t in enumerate(said)], "i int, title string, text string")
    whole = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    extra = (r"\bsecret\s+plan\b",)
    each = rows.select("i", F.array_compact(F.array(*(F.when(whole.rlike(f"(?iU){p}"), F.lit(p)) for p in (*rules.SCREEN_PATTERNS, *extra)))).alias("matched"))
    assert sorted((r.i, r.matched) for r in rules.matched_patterns(rows, extra).select("i", "matched").collect()) == sorted(map(tuple, each.collect()))

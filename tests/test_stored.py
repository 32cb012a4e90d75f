import pytest
from pyspark.sql import functions as F

from quarry import versions
from quarry.operators import stored, words
from quarry.operators.access import Principal

KINDS = "chunk_id long, source_type string, tlp_rank int, text string"


def made(spark, rows):
    chunks = spark.createDataFrame(rows, KINDS)
    return chunks, chunks.select("chunk_id", F.lit("main").alias("vector_name"), F.array(F.col("chunk_id").cast("double"), F.lit(1.0)).alias("embedding"))


def ids(held):
    return sorted(r.chunk_id for r in held.chunks.collect())


ROWS = [(1, "attack_cti", 0, "alpha beta"), (2, "nvd_cve", 2, "beta"), (3, "nvd_cve", 1, "gamma t1055"), (4, None, 3, None)]


def test_changes_go_back_to_the_path_they_were_read_from(spark, tmp_path):
    path = str(tmp_path / "c")
    first = stored.create(spark, path, *made(spark, ROWS), {"main": 2, "second": 2}, hybrid=True)
    old = stored.open_stored(spark, path)
    assert (old.number, ids(old), old.count("main")) == (0, [1, 2, 3, 4], 4)
    # of two rows of one id the last one counts, once
    held = stored.open_stored(spark, path)
    new, vectors = made(spark, [(2, "attack_cti", 0, "older"), (2, "attack_cti", 0, "newer delta"), (7, "attack_cti", 0, "delta")])
    second = held.upsert(new.coalesce(1), vectors.coalesce(1))
    third, counts = stored.open_stored(spark, path).attach("second", made(spark, [(1, "", 0, ""), (9, "", 0, "")])[1].drop("vector_name"))
    assert tuple(counts.first()) == (2, 1, 1)
    third, _ = stored.open_stored(spark, path).attach("second", made(spark, [(1, "", 0, ""), (3, "", 0, "")])[1].drop("vector_name"))
    assert sorted((r.chunk_id, r.vector_name) for r in third.vectors.collect()) == [(1, "main"), (1, "second"), (2, "main"), (3, "main"), (3, "second"), (4, "main"), (7, "main")]
    fourth, n = stored.open_stored(spark, path).delete_by_source_type("nvd_cve")
    assert n == 1 and ids(fourth) == [1, 2, 4, 7]
    assert {r.chunk_id: r.text for r in fourth.chunks.collect()}[2] == "newer delta"
    # a reader of an older version is undisturbed
    assert ids(old) == [1, 2, 3, 4] and {r.chunk_id: r.text for r in old.chunks.collect()}[2] == "beta"
    assert ids(stored.open_stored(spark, path, 1)) == [1, 2, 3, 4, 7]
    packed = fourth.compact()
    assert ids(packed) == ids(fourth) and len(packed.segments) == 1
    assert sorted(map(str, packed.vectors.collect())) == sorted(map(str, fourth.vectors.collect()))
    assert packed.vacuum() == 5 and ids(stored.open_stored(spark, path)) == [1, 2, 4, 7]
    assert packed.drop() and versions.numbers(spark, path) == []
    with pytest.raises(FileNotFoundError):
        stored.open_stored(spark, path)
    assert first.number == 0 and second.number == 1


def test_of_two_changes_to_one_version_the_second_fails(spark, tmp_path):
    path = str(tmp_path / "c")
    stored.create(spark, path, *made(spark, ROWS), {"main": 2}, hybrid=True)
    one, two = stored.open_stored(spark, path), stored.open_stored(spark, path)
    one.delete(spark.createDataFrame([(1,)], "chunk_id long"))
    with pytest.raises(FileExistsError):
        two.delete(spark.createDataFrame([(2,)], "chunk_id long"))
    assert ids(stored.open_stored(spark, path)) == [2, 3, 4]
    # nor does what the second wrote disturb the next change
    assert ids(stored.open_stored(spark, path).delete(spark.createDataFrame([(3,)], "chunk_id long"))) == [2, 4]


def test_search_follows_changes(spark, tmp_path):
    path = str(tmp_path / "c")
    held = stored.create(spark, path, *made(spark, ROWS), {"main": 2}, hybrid=True, avg_len=3.0)
    asked = spark.createDataFrame([(1, [1.0, 0.0], "gamma delta T1055")], "query_id long, embedding array<double>, question string")
    found = lambda h, **o: [r.chunk_id for r in h.search(asked, "main", 3, **o).orderBy("rank").collect()]
    assert found(held) == [4, 3, 2] and found(held, principal=Principal("p", clearance="amber")) == [3, 2, 1]
    assert found(held, mode="hybrid")[0] == 3
    after = held.upsert(*made(spark, [(9, "attack_cti", 0, "delta delta delta")])).delete(spark.createDataFrame([(3,)], "chunk_id long"))
    assert found(after) == [9, 4, 2] and found(after, mode="hybrid")[0] == 9
    terms = {r.term: r.df for r in after.word_index().terms.collect()}
    assert terms == {"alpha": 1, "beta": 2, "delta": 1}
    # the same as an index made of what is there now
    again = words.create(spark, str(tmp_path / "w"), after.chunks, avg_len=3.0)
    assert sorted(map(tuple, again.topk(asked, 5).collect())) == sorted(map(tuple, after.word_index().topk(asked, 5).collect()))
    with pytest.raises(ValueError):
        found(held, mode="sparse")
    with pytest.raises(ValueError):
        stored.create(spark, str(tmp_path / "d"), *made(spark, ROWS), {"main": 2}).word_index()
    with pytest.raises(KeyError):
        held.attach("unknown", made(spark, ROWS)[1])


def test_new_columns_and_empty_changes(spark, tmp_path):
    path = str(tmp_path / "c")
    held = stored.create(spark, path, *made(spark, []), {"main": 2})
    assert ids(held) == [] and held.count() == 0
    chunks, vectors = made(spark, ROWS[:1])
    held = held.upsert(chunks.withColumn("title", F.lit("t")), vectors).upsert(*made(spark, [(None, "x", 0, "no id")]))
    assert ids(held) == [1] and held.chunks.first().title == "t"
    assert held.delete(spark.createDataFrame([], "chunk_id long")).count() == 1

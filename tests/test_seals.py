import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.operators import seals, theft
from quarry.plans import assemble


def plain_root(rows, depth):
    """rows: {key: row as it is written}; the tree by dictionaries."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = {sha(f"{len(k)}:{k}"): sha(v) for k, v in rows.items()}
    level = {}
    for place in sorted(told):
        level[place[:depth]] = level.get(place[:depth], "") + told[place]
    level = {k: sha(v) for k, v in level.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for node in sorted(level):
            up.setdefault(node[:d], []).append(f"{node}={level[node]}")
        level = {k: sha(" ".join(v)) for k, v in up.items()}
    return level.get("", sha(""))


def test_root_and_altered_rows(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v")).repartition(5)
    path = str(tmp_path / "s")
    proof = seals.seal(rows, "k", path)
    written = {f"k{i}": f"1:k={len(f'k{i}')}:k{i}1:v={f'{len(str(i))}:{i}' if i % 7 else '-'}" for i in range(500)}
    assert seals.depth_for(500) == 2 and proof == plain_root(written, 2) == seals.tree(rows, "k", 2).where("node = ''").first().digest
    assert seals.seal(rows.repartition(2), "k", str(tmp_path / "again")) == proof
    assert seals.altered(rows, "k", path, proof=proof).count() == 0
    changed = rows.where("k <> 'k33'").withColumn("v", F.when(F.col("k") == "k8", 9).otherwise(F.col("v"))).unionByName(spark.createDataFrame([("new", 1)], "k string, v long"))
    sha = lambda k: hashlib.sha256(f"{len(k)}:{k}".encode()).hexdigest()[:2]
    found = {r.node: r for r in seals.altered(changed, "k", path, proof=proof).collect()}
    assert set(found) == {sha("k8"), sha("k33"), sha("new")}
    assert "k8" in found[sha("k8")]["keys"] and "k33" not in (found[sha("k33")]["keys"] or []) and all(r.sealed != r.found for r in found.values())
    with pytest.raises(ValueError):
        seals.altered(rows, "k", path, proof="0" * 64)
    with pytest.raises(Exception, match="more than once"):
        seals.leaves(rows.unionByName(rows.limit(1)), "k", 1).collect()
    assert seals.seal(rows.limit(0), "k", str(tmp_path / "none")) == hashlib.sha256(b"").hexdigest()
    assert seals.altered(rows.limit(0), "k", str(tmp_path / "none")).count() == 0
    # null and empty, and values that run into each other, are told apart
    pairs = [[("a", None), ("b", "x")], [("a", ""), ("b", "x")], [("a", "1:b"), ("b", "x")]]
    assert len({seals.tree(spark.createDataFrame(p, "k string, v string"), "k", 0).first().digest for p in pairs}) == 3


def test_bundles_are_checked_by_their_manifest(spark, tmp_path):
    sample = spark.createDataFrame([(f"c{i}", f"alpha beta secret{i} gamma", [f"secret{i}", "gamma"], "note") for i in range(40)], "chunk_id string, text string, secret_terms array<string>, source_type string")
    path = str(tmp_path / "b")
    vectors = sample.where("chunk_id <> 'c3'").select("chunk_id", assemble.embedded(F.col("text")).alias("embedding"))
    assert [r[0] for r in theft.export_bundle(sample, vectors, path).collect()] == ["c3"]
    manifest = {r.part: r.rows for r in spark.read.json(f"{path}/manifest").collect()}
    assert manifest == {"vectors": 39, "truth": 40} and theft.altered(spark, path).count() == 0
    spoiled = theft.load_truth(spark, path).withColumn("text", F.when(F.col("chunk_id") == "c7", "else").otherwise(F.col("text"))).collect()
    spark.createDataFrame(spoiled, sample.schema).write.mode("overwrite").parquet(f"{path}/truth")
    rows = theft.altered(spark, path).collect()
    assert len(rows) == 1 and rows[0].part == "truth" and "c7" in rows[0]["keys"]

    control = str(tmp_path / "control")
    theft.export_control(sample, control, 3, assemble.embedded)
    truth = theft.load_truth(spark, control).where("chunk_id = 'c5'").first()
    assert truth.text == "alpha beta secret5" and truth.secret_terms == ["secret5"]
    got = theft.load_vectors(spark, control).where("chunk_id = 'c5'").first().embedding
    assert got == pytest.approx(spark.range(1).select(assemble.embedded(F.lit("alpha beta secret5"))).first()[0])
    assert theft.altered(spark, control).count() == 0

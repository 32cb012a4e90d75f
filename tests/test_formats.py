import json

import pytest
from pyspark.sql import functions as F

from quarry.plans import catalog
from quarry.sources import cve, files, formats, stix

REF = lambda i: [{"source_name": "mitre-attack", "external_id": i, "url": f"https://x/{i}"}]


@pytest.fixture(autouse=True)
def known(spark):
    formats.register(spark)


def bundle(*objects):
    return json.dumps({"type": "bundle", "objects": list(objects)})


def test_bundles(spark, tmp_path):
    (tmp_path / "a.json").write_text(bundle({"id": "ap1", "type": "attack-pattern", "name": "Injection", "description": "Runs.", "external_references": REF("T1055"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "x"}], "unknown": 1}))
    (tmp_path / "b.json").write_text(bundle({"id": "g1", "type": "intrusion-set", "name": "Panda", "external_references": REF("G4")}, {"id": "r1", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "ap1", "description": "did"}))
    (tmp_path / "_SUCCESS").write_text("")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = spark.read.format("stix").load(path)
        assert rows.rdd.getNumPartitions() == 2
        objs = stix.with_reference(rows)
        assert sorted(r.source_ref for r in stix.documents(objs).collect()) == ["G4", "T1055"]
        assert [tuple(r) for r in stix.gold_edges(objs).collect()] == [("G4", "Panda", "x", "T1055")]
    native = stix.objects(spark, str(tmp_path / "b.json"))
    assert sorted(map(str, native.collect())) == sorted(map(str, stix.with_reference(spark.read.format("stix").load(str(tmp_path / "b.json"))).collect()))
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(Exception, match="no bundle"):
        spark.read.format("stix").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("stix").load(str(tmp_path / "nowhere")).collect()


def test_options_choose_rows(spark, tmp_path):
    pages = [[{"cve": {"id": f"CVE-{10 * p + i}", "published": f"2024-0{p + 1}-1{i}", "vulnStatus": "Analyzed" if i else None}} for i in range(3)] for p in range(3)]
    for i, p in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps({"vulnerabilities": p, "totalResults": 3}))
    rows = spark.read.format("nvd").load(str(tmp_path))
    some = spark.read.format("nvd").option("from", "2024-02").option("before", "2024-03").option("only", json.dumps({"vulnStatus": ["Analyzed", "x"]})).load(str(tmp_path))
    assert sorted(r.id for r in some.collect()) == ["CVE-11", "CVE-12"]
    assert sorted(r.id for r in rows.where("published >= '2024-02' and published < '2024-03' and vulnStatus in ('Analyzed', 'x')").collect()) == ["CVE-11", "CVE-12"]
    assert rows.where("vulnStatus is null").count() == 3 and rows.where(F.length("id") > 5).count() == 6
    assert sorted(r.source_ref for r in cve.documents(rows).collect()) == sorted(f"CVE-{10 * p + i}" for p in range(3) for i in range(3))
    assert sorted(map(str, cve.records(spark, str(tmp_path)).collect())) == sorted(map(str, rows.collect()))


def test_notes(spark, tmp_path):
    (tmp_path / "n.yaml").write_text("notes:\n- {id: A1, title: One, tlp: red, trust_tier: 2, text: 'said'}\n- {id: A2, title: Two, tlp: green, trust_tier: 1, text: t, techniques: [T1]}\n")
    (tmp_path / "empty.yml").write_text("")
    rows = spark.read.format("notes").load(str(tmp_path))
    assert sorted((r.id, r.tlp, r.techniques) for r in rows.collect()) == [("A1", "red", []), ("A2", "green", ["T1"])]
    assert [r.id for r in rows.where("tlp = 'red' and trust_tier <= 2").collect()] == ["A1"]
    assert [r.id for r in spark.read.format("notes").option("only", '{"trust_tier": [1]}').load(str(tmp_path)).collect()] == ["A2"]
    for option in (("only", '{"colour": ["x"]}'), ("from", "2024")):
        with pytest.raises(Exception, match="no columns|no date"):
            spark.read.format("notes").option(*option).load(str(tmp_path)).collect()
    assert sorted(r.text for r in files.note_documents(rows).collect()) == ["# A1 - One\n\nsaid", "# A2 - Two\n\nt"]
    for bad in ("{id: B, title: x, tlp: pink, trust_tier: 1, text: t}", "{id: B, title: x, tlp: red, text: t}", "{id: B, title: x, tlp: red, trust_tier: 1, text: t}\n- {id: B, title: x, tlp: red, trust_tier: 1, text: t}"):
        (tmp_path / "bad.yaml").write_text(f"notes:\n- {bad}\n")
        with pytest.raises(Exception, match="note 'B'"):
            spark.read.format("notes").load(str(tmp_path)).collect()


def test_bundles_grow_in_number_and_not_in_size(spark, sf, monkeypatch):
    def made(most):
        monkeypatch.setattr(catalog, "_OBJECTS", most)
        rows = catalog._bundles(spark, sf)
        return rows.count(), sorted(r[0] for r in rows.groupBy("bundle").count().select("count").collect())

    (n, few), (again, many) = made(1 << 14), made(40)
    assert n == again == sum(few) == sum(many)
    assert len(few) == 17 and max(many) <= 40 < max(few)


def test_objects_with_few_fields_keep_the_others_null(spark, tmp_path):
    (tmp_path / "a.json").write_text(bundle({"id": "x"}, {"name": "n", "aliases": ["a"], "unknown": 1}))
    rows = sorted(spark.read.format("stix").load(str(tmp_path)).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.id, r.name, r.aliases, r.type) for r in rows] == [(0, "x", None, None, None), (1, None, "n", ["a"], None)]

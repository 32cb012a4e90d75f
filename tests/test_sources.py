import hashlib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import gold, sweep, theft
from quarry.plans import config
from quarry.sources import cve, files, pages, stix
from quarry.streaming import ingest

REF = lambda i: [{"source_name": "mitre-attack", "external_id": i, "url": f"https://x/{i}"}]
BUNDLE = [
    {"id": "ap1", "type": "attack-pattern", "name": "Injection", "description": "Runs code. CVE-2020-1234", "external_references": REF("T1055"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "defense-evasion"}], "x_mitre_platforms": ["Windows"]},
    {"id": "ap2", "type": "attack-pattern", "name": "Old", "description": "x", "external_references": REF("T1"), "x_mitre_detection": "inline text", "aliases": ["Old", "Older"]},
    {"id": "ap3", "type": "attack-pattern", "name": "Gone", "revoked": True, "external_references": REF("T2")},
    {"id": "g1", "type": "intrusion-set", "name": "Panda", "external_references": REF("G0004")},
    {"id": "st", "type": "x-mitre-detection-strategy", "name": "Watch", "x_mitre_analytic_refs": ["an1", "an2"]},
    {"id": "an1", "type": "x-mitre-analytic", "description": " look ", "x_mitre_log_source_references": [{"name": "Sysmon", "channel": "7"}, {"name": "Flow"}, {"name": " "}]},
    {"id": "an2", "type": "x-mitre-analytic", "description": "hidden", "x_mitre_deprecated": True},
    {"id": "r1", "type": "relationship", "relationship_type": "detects", "source_ref": "st", "target_ref": "ap1"},
    {"id": "r2", "type": "relationship", "relationship_type": "detects", "source_ref": "st", "target_ref": "ap2"},
    {"id": "r3", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "ap1", "description": "used it, cve-2021-44228"},
    {"id": "r4", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "ap2", "description": "  "},
]


@pytest.fixture
def objs(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "objects": BUNDLE}))
    return stix.objects(spark, str(tmp_path / "b.json"))


def test_stix_documents(objs):
    docs = {r.source_ref: r for r in stix.documents(objs).collect()}
    assert set(docs) == {"T1055", "T1", "G0004"}
    assert docs["T1055"].text == (
        "# T1055 - Injection\n\n## Description\nRuns code. CVE-2020-1234\n\n## Detection\n### Watch\nlook\nLog sources: Sysmon (7); Flow\n\n## Tactics\ndefense-evasion\n\n"
        "## Platforms\nWindows\n\n## Procedure Examples\n- Panda (G0004): used it, cve-2021-44228\n"
    )
    assert "## Detection\ninline text\n" in docs["T1"].text and "## Aliases\nOlder\n" in docs["T1"].text and "Procedure" not in docs["T1"].text
    assert docs["T1055"].title == "T1055 Injection (technique)" and docs["G0004"].text == "# G0004 - Panda\n" and docs["T1055"].meta["is_subtechnique"] == "False"
    assert {r.cve: r.attack_ids for r in stix.cve_links(objs).collect()} == {"CVE-2020-1234": ["T1055"], "CVE-2021-44228": ["G0004", "T1055"]}
    assert sorted((r.group_id, r.tactic, r.technique) for r in stix.gold_edges(objs).collect()) == [("G0004", "defense-evasion", "T1055"), ("G0004", "unspecified", "T1")]


def test_cve_documents(spark, tmp_path):
    record = {
        "id": "cve-2024-3094", "published": "2024", "vulnStatus": "Analyzed", "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": " Bad code. "}],
        "metrics": {"cvssMetricV31": [{"type": "Secondary", "cvssData": {"version": "3.1", "baseScore": 1.0}}, {"type": "Primary", "cvssData": {"version": "3.1", "baseScore": 10.0, "baseSeverity": "critical", "vectorString": "V"}}]},
        "weaknesses": [{"description": [{"lang": "en", "value": "CWE-506"}]}, {"description": [{"lang": "en", "value": "NVD-CWE-noinfo"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:tuk_x:xz:5.6:*"}, {"criteria": "cpe:2.3:a:tuk_x:xz:5.7:*"}, {"criteria": "short"}]}]}], "references": [{"url": "u", "tags": ["Patch"]}, {"url": "v"}],
    }
    bare = {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "** REJECT ** no"}]}
    (tmp_path / "p.json").write_text(json.dumps({"vulnerabilities": [{"cve": record}, {"cve": bare}], "totalResults": 2}))
    recs = cve.records(spark, str(tmp_path / "p.json"))
    links = spark.createDataFrame([("CVE-2024-3094", ["T1", "T2"])], "cve string, attack_ids array<string>")
    docs = {r.source_ref: r for r in cve.documents(recs, links).collect()}
    assert docs["CVE-2024-3094"].text == (
        "# CVE-2024-3094\n\n## Description\nBad code.\n\n## Severity\nCVSS v3.1 base score 10.0 (CRITICAL)\nVector: V\n\n## Weaknesses\nCWE-506\n\n## Affected Products\ntuk x xz\n\n"
        "## References\nPatch (2 references)\n\n## Discussed by ATT&CK\nT1, T2\n"
    )
    assert docs["CVE-2024-3094"].title == "CVE-2024-3094 (CRITICAL)" and docs["CVE-1"].title == "CVE-1" and docs["CVE-1"].meta["cvss_score"] == ""
    assert [r.id for r in recs.where(~cve.rejected()).collect()] == ["cve-2024-3094"]
    many = spark.range(1).select(cve.bounded(F.array(*(F.lit(str(i)) for i in range(30))), 25, "things").alias("x")).first().x
    assert many.endswith("24\n... and 5 more things not shown")
    spans = list(cve.windows_back_from(datetime(2026, 1, 1), 18))
    assert len(spans) == 5 and spans[0][1] == datetime(2026, 1, 1) and sum((b - a).days for a, b in spans) == 547


def test_yaml_sources(spark, tmp_path):
    note = "- {id: INT-1, title: t, tlp: amber, trust_tier: 1, techniques: [T1], secret_terms: [Falcon], text: body}\n"
    (tmp_path / "n.yaml").write_text("notes:\n" + note)
    docs = files.note_documents(files.notes(spark, str(tmp_path / "n.yaml"))).first()
    assert docs.text == "# INT-1 - t\n\nbody" and docs.tlp == "amber" and docs.meta_lists["secret_terms"] == ["Falcon"]
    for bad in ("notes:\n" + note + note, "notes:\n- {id: a, title: t, trust_tier: 1, text: x}\n", "notes:\n- {id: a, title: t, tlp: odd, trust_tier: 1, text: x}\n"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            files.notes(spark, str(tmp_path / "bad.yaml"))
    content = b"data"
    (tmp_path / "m.yaml").write_text(f"reports:\n- {{id: r1, title: t, publisher: P, published: '2025', url: u, filename: f.pdf, sha256: {hashlib.sha256(content).hexdigest()}}}\n")
    reports = files.manifest(spark, str(tmp_path / "m.yaml"))
    blobs = lambda c: spark.createDataFrame([("file:/x/f.pdf", bytearray(c))], "path string, content binary")
    assert files.verified(reports, blobs(content)).count() == 1
    with pytest.raises(Exception, match="digest"):
        files.verified(reports, blobs(b"other")).collect()
    assert files.report_documents(reports, spark.createDataFrame([("f.pdf", "body")], "filename string, text string")).first().title == "P: t"
    cases = tmp_path / "attacks"
    cases.mkdir()
    (cases / "a.yaml").write_text("{id: a1, family: injection, target_query: q, doc: {title: t, source_ref: D, text: 'x {SINK}'}, success: [{type: output_contains, value: ok}]}")
    row = files.attacks(spark, str(cases)).first()
    assert row.doc.trust_tier == 3 and row.success[0].case_sensitive is False


def test_pages(spark):
    said = ["Acme Report 2025 page 1\nThe cre-\ndential was\n\n7\nTTHHRREEAATT", "Acme Report 2025 page 2\nsame same\nsame same\nContents .... 12\nPage 8 of 40", "Acme Report 2025 page 3\n\n\n\nlast HTTP ll line"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(said)] + [("e", 0, None)], "doc string, page int, text string")
    got = {r.doc: r.text for r in pages.clean(df).collect()}
    assert got == {"d": "The credential was\nTHREAT\n\nsame same\nsame same\n\nlast HTTP ll line", "e": ""}
    with pytest.raises(Exception, match="too little text"):
        pages.clean(df, least_per_page=200).collect()
    doubled = spark.createDataFrame([(x,) for x in ("aabb", "AA BB CC!", "aabbcd", "aabbccc", "éé22 ßß--", "")], "line string")
    assert [r[0] for r in doubled.select(pages.undoubled(F.col("line"))).collect()] == ["aabb", "A B C!", "aabbcd", "aabbccc", "é2 ß-", ""]


def test_selection_and_samples(spark):
    linked = spark.createDataFrame([("cve-1",)], "id string")
    recent = spark.createDataFrame([("CVE-1", 0, 0, 0), ("CVE-2", 0, 0, 1), ("CVE-2", 1, 0, 0), ("CVE-3", 1, 0, 1), ("CVE-4", 1, 1, 0)], "id string, window int, severity_rank int, pos int")
    assert sorted((r.part, r.id) for r in cve.select(linked, recent, 2).collect()) == [(0, "CVE-1"), (1, "CVE-2"), (1, "CVE-3")]
    seats = {r.source_type: r.seats for r in gold.quotas(spark.createDataFrame([("a", 2000), ("b", 1000), ("c", 200)], "source_type string, n long"), 300).collect()}
    assert sum(seats.values()) == 300 and seats == {"a": 187, "b": 94, "c": 19}
    chunks = spark.createDataFrame([(f"k{i}", t) for t, n in (("x", 40), ("internal_note", 5), ("synthetic_adversarial", 3)) for i in range(n)], "chunk_id string, source_type string")
    got = gold.stratified_sample(chunks, 10, seed=1)
    assert {r.source_type: r["count"] for r in got.groupBy("source_type").count().collect()} == {"x": 10, "internal_note": 5}
    assert got.exceptAll(gold.stratified_sample(chunks.repartition(5), 10, seed=1)).isEmpty()


def test_probes(spark):
    docs = [("T1", "T1 Alpha (technique)"), ("G1", "G1 Shared (group)"), ("S1", "S1 shared (software)"), ("M1", "M1 Thing (mitigation)"), ("CVE-2024-1111", "CVE-2024-1111 (HIGH)"), ("N", "a note")]
    got = sorted(r.id for r in gold.identifier_probes(spark.createDataFrame(docs, "source_ref string, title string")).collect())
    assert got == ["CVE-2024-1111:id", "T1:id", "T1:name"]


def test_theft(spark, tmp_path):
    ref = spark.createDataFrame([(1, "d1", "T1", "T1 Falcon (group)", [1.0, 0.0]), (2, "d2", "T2", "T2 Other thing (group)", [0.0, 1.0])], "ref_id int, doc_id string, source_ref string, title string, embedding array<double>")
    stolen = spark.createDataFrame([(10, "d1", "a", "about falcon", [2.0, 0.1]), (11, "d9", "b", "mentions t2 only", [0.0, 3.0])], "chunk_id int, doc_id string, source_type string, text string, embedding array<double>")
    rows = theft.reidentify(stolen, ref)
    got = {r.chunk_id: (r.correct, r.in_reference, r.topic_hit, r.ref_hit) for r in rows.collect()}
    assert got == {10: (True, True, True, False), 11: (False, False, False, True)}
    top = [r for r in theft.report(rows).collect() if r.level == 1][0]
    assert (top.recognisable, top.recognised, top.hidden, top.topic_hits, top.ref_hits) == (1, 1, 1, 0, 1)
    missing = theft.export_bundle(stolen, stolen.select("chunk_id", "embedding").where("chunk_id = 10"), str(tmp_path / "b"))
    assert [r.chunk_id for r in missing.collect()] == [11] and "embedding" not in theft.load_truth(spark, str(tmp_path / "b")).columns
    (tmp_path / "r.jsonl").write_text('{"chunk_id":"a","reconstruction":"x"}\n{"chunk_id":"a","reconstruction":"y"}\n{"chunk_id":"b","reconstruction":null}\n')
    assert [tuple(r) for r in theft.load_reconstructions(spark, str(tmp_path / "r.jsonl")).collect()] == [("a", "y")]


def test_sweep(spark, tmp_path):
    cells = sweep.grid(spark, ["m"], ["none", "all"], 2)
    path = str(tmp_path / "rows")
    assert sweep.pending(cells, sweep.evidence(spark, path)).count() == 4
    routes = lambda *s: [("main", len(s), 3, list(s), 0)]
    rows = spark.createDataFrame([("none", "m", 1, [], routes("a", "b"), {}, {}, 1.0, True), ("none", "m", 2, [], routes("a"), {}, {}, 1.0, True), ("all", "m", 1, [], routes(), {}, {}, 1.0, None)], sweep.ROW)
    sweep.record(rows, path)
    done = sweep.evidence(spark, path)
    assert [r.key for r in sweep.pending(cells, done).collect()] == ["all@m#2"]
    got = {r.label: (r.repeats, r.landed_low, r.landed_high, r.unstable) for r in sweep.attack_ranges(done).collect()}
    assert got == {"none": (2, 1, 2, ["b"]), "all": (1, 0, 0, [])}
    assert sweep.same_twice(rows.select("label"), done.select("label"))


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("retrieval: {top_k: 7}\nrules: {enabled: [source_cap]}\n")
    (tmp_path / "b.yaml").write_text("retrieval: {overfetch: 3}\n")
    c = config.load(str(tmp_path / "a.yaml"), (str(tmp_path / "b.yaml"),), {"QUARRY_RETRIEVAL__TOP_K": "9", "QUARRY_MAX_CONTEXT_CHARS": " "})
    assert (c.retrieval.top_k, c.retrieval.overfetch, c.rules.enabled, c.max_context_chars) == (9, 3, ["source_cap"], 6000)
    for env in ({"QUARRY_RETRIEVAL__MODE": "hybrid", "QUARRY_RETRIEVAL__SCORE_THRESHOLD": "0.2"}, {"QUARRY_NONE": "1"}, {"QUARRY_RETRIEVAL__MODE": "odd"}):
        with pytest.raises(ValueError):
            config.load(env=env)
    env = {"A": "1"}
    (tmp_path / ".env").write_text("A=2\nB='x'\nC=\n# D=1\n")
    config.load_dotenv(str(tmp_path / ".env"), env)
    assert env == {"A": "1", "B": "'x'".strip("'")}


def test_streaming_ingest(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x" * 600), ("b", "short")], "id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest.append(ingest.chunks_of(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("cap", [1, 3, 8, 40])
def test_budget_that_passes_on(spark, cap):
    """Withdrawn and repeated rows use a call's budget up, and what they leave goes to the next call."""
    rng = random.Random(cap)
    calls = [[(f"CVE-{rng.randint(0, 25)}", rng.random() < 0.8) for _ in range(rng.choice([0, 1, 4, 12]))] for _ in range(9)]
    rows = [(name, i // 3, i % 3, p, "Analyzed" if live else "Rejected", []) for i, c in enumerate(calls) for p, (name, live) in enumerate(c)]
    recent = spark.createDataFrame(rows, "id string, window int, severity_rank int, pos int, vulnStatus string, descriptions array<struct<lang:string,value:string>>").repartition(4)
    linked = spark.createDataFrame([("cve-3",), ("CVE-99",)], "id string")
    got = cve.select(linked, recent, cap, cap_fetched=True)
    seen, taken = {"CVE-3", "CVE-99"}, []
    for c in calls:
        left = cap - len(taken)
        for name, live in c[:left]:
            if live and name not in seen:
                seen.add(name)
                taken.append(name)
    assert sorted(r.id for r in got.where("part = 1").collect()) == sorted(taken)
    assert sorted(r.id for r in got.where("part = 0").collect()) == ["CVE-3", "CVE-99"]

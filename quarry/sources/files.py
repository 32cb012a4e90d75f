"""Notes, manifests and attack cases written by hand in YAML: read on the driver, validated, typed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.access import TLP

NOTE = "id string, title string, tlp string, trust_tier int, techniques array<string>, secret_terms array<string>, text string"
REPORT = "id string, title string, publisher string, published string, url string, filename string, via string, sha256 string"
ATTACK = (
    "id string, family string, description string, target_query string, clearance string, "
    "doc struct<title:string,source_ref:string,text:string,tlp:string,trust_tier:int>, success array<struct<type:string,value:string,case_sensitive:boolean>>"
)


def _yaml(path: Path):
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8"))


def _unique(rows: list[dict], required: tuple[str, ...], what: str) -> list[dict]:
    seen: set[str] = set()
    for row in rows:
        if missing := [k for k in required if row.get(k) is None]:
            raise ValueError(f"{what} {row.get('id')!r} lacks {missing}")
        if row["id"] in seen:
            raise ValueError(f"{what} {row['id']!r} appears twice")
        seen.add(row["id"])
    return rows


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Internal notes; classification and tier have no defaults."""
    rows = _unique((_yaml(Path(path)) or {}).get("notes") or [], ("id", "title", "tlp", "trust_tier", "text"), "note")
    for row in rows:
        if row["tlp"] not in TLP:
            raise ValueError(f"note {row['id']!r} has unknown classification {row['tlp']!r}")
    return spark.createDataFrame([(r["id"], r["title"], r["tlp"], int(r["trust_tier"]), list(r.get("techniques") or []), list(r.get("secret_terms") or []), r["text"]) for r in rows], NOTE)


def note_documents(rows: DataFrame) -> DataFrame:
    said = F.concat(F.lit("# "), "id", F.lit(" - "), "title", F.lit("\n\n"), "text")
    return rows.select(
        F.concat(F.lit("note:"), "id").alias("id"), "title", said.alias("text"), F.lit("internal_note").alias("source_type"), F.col("id").alias("source_ref"), F.lit(None).cast("string").alias("url"), "tlp", "trust_tier",
        F.create_map(F.lit("synthetic"), F.lit("True")).alias("meta"), F.create_map(F.lit("techniques"), F.col("techniques"), F.lit("secret_terms"), F.col("secret_terms")).alias("meta_lists"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    names = [x.split()[0] for x in REPORT.split(", ")]
    rows = _unique((_yaml(Path(path)) or {}).get("reports") or [], tuple(n for n in names if n != "via"), "report")
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], REPORT)


def verified(reports: DataFrame, files: DataFrame) -> DataFrame:
    """reports joined with files(path, content) by name; a digest that differs fails the job."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("digest"))
    good = F.when(F.lower("sha256") == F.col("digest"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("digest of "), "filename", F.lit(" differs from the manifest"))))
    return reports.join(named, "filename").where(good)


def report_documents(reports: DataFrame, bodies: DataFrame) -> DataFrame:
    """reports joined with bodies(filename, text)."""
    rows = reports.join(bodies, "filename")
    return rows.select(
        F.concat(F.lit("vendor:"), "id").alias("id"), F.concat("publisher", F.lit(": "), "title").alias("title"), "text", F.lit("vendor_report").alias("source_type"), F.col("id").alias("source_ref"), "url",
        F.lit("clear").alias("tlp"), F.lit(1).alias("trust_tier"), F.create_map(F.lit("publisher"), F.col("publisher"), F.lit("published"), F.col("published")).alias("meta"),
        F.create_map().cast("map<string,array<string>>").alias("meta_lists"),
    )


def attacks(spark: SparkSession, folder: str) -> DataFrame:
    """Attack cases of a folder's own *.yaml files, by name."""
    rows = _unique([_yaml(p) for p in sorted(Path(folder).glob("*.yaml"))], ("id", "family", "target_query", "doc", "success"), "attack")
    doc = lambda d: (d["title"], d["source_ref"], d["text"], d.get("tlp", "clear"), int(d.get("trust_tier", 3)))
    return spark.createDataFrame([(r["id"], r["family"], r.get("description"), r["target_query"], r.get("clearance", "clear"), doc(r["doc"]), [(s["type"], str(s["value"]), bool(s.get("case_sensitive", False))) for s in r["success"]]) for r in rows], ATTACK)

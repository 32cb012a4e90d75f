"""STIX bundles as documents, links and gold edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text
from quarry.functions.text import rstrip, section, strip

# Object types that become documents, and actors whose `uses` edges become procedure examples.
KINDS = {"attack-pattern": "technique", "intrusion-set": "group", "malware": "software", "tool": "software", "course-of-action": "mitigation", "x-mitre-tactic": "tactic"}
PROCEDURE_ACTORS = ("intrusion-set", "malware", "tool", "campaign")
SCHEMA = (
    "type string, objects array<struct<id:string,type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,"
    "external_references:array<struct<source_name:string,external_id:string,url:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "x_mitre_platforms:array<string>,aliases:array<string>,x_mitre_is_subtechnique:boolean,x_mitre_detection:string,x_mitre_analytic_refs:array<string>,"
    "x_mitre_log_source_references:array<struct<name:string,channel:string>>,relationship_type:string,source_ref:string,target_ref:string>>"
)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a bundle with pos, their place in it; a missing file fails."""
    bundle = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return with_reference(bundle.select(F.posexplode("objects").alias("pos", "o")).select("pos", "o.*"))


def with_reference(objs: DataFrame) -> DataFrame:
    own = F.filter("external_references", lambda r: (r["source_name"] == "mitre-attack") & (F.coalesce(r["external_id"], F.lit("")) != ""))
    first = F.get(own, F.lit(0))
    return objs.withColumn("ref", first["external_id"]).withColumn("url", first["url"])


def _live(revoked: bool, deprecated: bool, prefix: str = "") -> Column:
    ok = F.lit(True)
    if not revoked:
        ok = ok & ~F.coalesce(F.col(f"{prefix}revoked"), F.lit(False))
    if not deprecated:
        ok = ok & ~F.coalesce(F.col(f"{prefix}x_mitre_deprecated"), F.lit(False))
    return ok


def by_id(objs: DataFrame) -> DataFrame:
    """One object for each id, the last of repeated ones."""
    last = Window.partitionBy("id").orderBy(F.desc("pos"))
    return objs.where("id is not null").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def _ordered(df: DataFrame, key: str, order: str, value: str, out: str, joiner: str) -> DataFrame:
    got = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("x"))
    return got.select(key, F.array_join(F.transform("x", lambda v: v[value]), joiner).alias(out))


def detections(objs: DataFrame, *, revoked: bool = False, deprecated: bool = False) -> DataFrame:
    """target_ref, detection: strategies that detect a technique, each with its analytics' text and log sources."""
    known = by_id(objs)
    rels = objs.where("type = 'relationship' and relationship_type = 'detects'").select("pos", "source_ref", "target_ref")
    strategies = known.where((F.col("type") == "x-mitre-detection-strategy") & _live(revoked, deprecated)).select(F.col("id").alias("source_ref"), F.coalesce("name", F.lit("Detection strategy")).alias("strategy"), "x_mitre_analytic_refs")
    edges = rels.join(strategies, "source_ref")
    name = lambda r: strip(F.coalesce(r["name"], F.lit("")))
    channel = lambda r: strip(F.coalesce(r["channel"], F.lit("")))
    logs = F.transform(F.filter("x_mitre_log_source_references", lambda r: name(r) != ""), lambda r: F.when(channel(r) != "", F.concat(name(r), F.lit(" ("), channel(r), F.lit(")"))).otherwise(name(r)))
    said, listed = strip(F.coalesce("description", F.lit(""))), F.coalesce(logs, F.array().cast("array<string>"))
    lines = F.filter(F.array(F.when(said != "", said), F.when(F.size(listed) > 0, F.concat(F.lit("Log sources: "), F.array_join(listed, "; ")))), lambda x: x.isNotNull())
    analytics = known.where(_live(True, deprecated)).select(F.col("id").alias("analytic"), F.array_join(lines, "\n").alias("block")).where("block <> ''")
    parts = edges.select("pos", "target_ref", "strategy", F.posexplode("x_mitre_analytic_refs").alias("nth", "analytic")).join(analytics, "analytic")
    one = parts.groupBy("pos", "target_ref", "strategy").agg(F.array_sort(F.collect_list(F.struct("nth", "block"))).alias("x"))
    one = one.withColumn("block", F.concat(F.lit("### "), "strategy", F.lit("\n"), F.array_join(F.transform("x", lambda v: v["block"]), "\n"), F.lit("\n")))
    return _ordered(one, "target_ref", "pos", "block", "detection", "\n")


def procedures(objs: DataFrame, *, revoked: bool = False, deprecated: bool = False) -> DataFrame:
    """target_ref, procedures: a line for each described `uses` edge of a live actor on a technique, in bundle order."""
    known = by_id(objs)
    rels = objs.where("type = 'relationship' and relationship_type = 'uses'").withColumn("said", strip(F.coalesce("description", F.lit("")))).where("said <> ''").select("pos", "source_ref", "target_ref", "said")
    actors = known.where(F.col("type").isin(*PROCEDURE_ACTORS) & _live(revoked, deprecated)).select(F.col("id").alias("source_ref"), "name", "ref")
    targets = known.where("type = 'attack-pattern'").select(F.col("id").alias("target_ref"))
    label = F.when(F.col("ref").isNotNull(), F.concat(F.coalesce("name", "ref"), F.lit(" ("), "ref", F.lit(")"))).otherwise(F.coalesce("name", F.lit("Unknown")))
    lines = rels.join(actors, "source_ref").join(targets, "target_ref").withColumn("line", F.concat(F.lit("- "), label, F.lit(": "), "said"))
    return _ordered(lines, "target_ref", "pos", "line", "procedures", "\n")


def documents(objs: DataFrame, *, revoked: bool = False, deprecated: bool = False) -> DataFrame:
    """Documents of all kept objects: head, then sections for description, detection, tactics, platforms, aliases and procedure examples."""
    kept = objs.where(F.col("type").isin(*KINDS) & _live(revoked, deprecated) & F.col("ref").isNotNull()).drop("source_ref", "target_ref")
    rows = kept.join(detections(objs, revoked=revoked, deprecated=deprecated), F.col("id") == F.col("target_ref"), "left").drop("target_ref")
    rows = rows.join(procedures(objs, revoked=revoked, deprecated=deprecated), F.col("id") == F.col("target_ref"), "left").drop("target_ref")
    none = F.array().cast("array<string>")
    name = F.coalesce("name", "ref")
    tactics = F.coalesce(F.transform(F.filter("kill_chain_phases", lambda p: (p["kill_chain_name"] == "mitre-attack") & (F.coalesce(p["phase_name"], F.lit("")) != "")), lambda p: p["phase_name"]), none)
    aliases = F.filter(F.coalesce("aliases", none), lambda a: a != name)
    platforms = F.coalesce("x_mitre_platforms", none)
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("type"))
    inline = F.coalesce("x_mitre_detection", F.lit(""))
    body = F.concat(
        section("Description", F.col("description")), section("Detection", F.when(inline != "", inline).otherwise(F.col("detection"))), section("Tactics", F.array_join(tactics, ", ")),
        section("Platforms", F.array_join(platforms, ", ")), section("Aliases", F.array_join(aliases, ", ")), section("Procedure Examples", F.col("procedures")),
    )
    return rows.select(
        F.concat(F.lit("attack:"), "ref").alias("id"), F.concat("ref", F.lit(" "), name, F.lit(" ("), kind, F.lit(")")).alias("title"),
        F.concat(rstrip(F.concat(F.lit("# "), "ref", F.lit(" - "), name, F.lit("\n\n"), body)), F.lit("\n")).alias("text"), F.lit("attack_cti").alias("source_type"), F.col("ref").alias("source_ref"), "url",
        F.lit("clear").alias("tlp"), F.lit(0).alias("trust_tier"),
        F.create_map(F.lit("kind"), kind, F.lit("name"), name, F.lit("stix_id"), F.col("id"), F.lit("is_subtechnique"), F.when(F.coalesce("x_mitre_is_subtechnique", F.lit(False)), "True").otherwise("False")).alias("meta"),
        F.create_map(F.lit("tactics"), tactics, F.lit("platforms"), platforms, F.lit("aliases"), aliases).alias("meta_lists"),
    )


def cve_links(objs: DataFrame) -> DataFrame:
    """cve, attack_ids: who mentions a CVE; a relationship's mention counts for both its ends."""
    said = objs.select("pos", "id", "type", "ref", "source_ref", "target_ref", F.explode(text.mentioned_cves(F.coalesce("description", F.lit("")))).alias("cve"))
    refs = by_id(objs).where("ref is not null").select("id", F.col("ref").alias("holder"))
    own = said.where("ref is not null").select("cve", F.col("ref").alias("holder"))
    ends = said.where("type = 'relationship'").select("cve", F.explode(F.array("source_ref", "target_ref")).alias("id")).join(refs, "id").select("cve", "holder")
    return own.unionByName(ends).groupBy("cve").agg(F.array_sort(F.collect_set("holder")).alias("attack_ids"))


def gold_edges(objs: DataFrame, *, revoked: bool = False, deprecated: bool = False) -> DataFrame:
    """group_id, group_name, tactic, technique of all `uses` edges from groups; a technique without tactic is `unspecified`."""
    known = by_id(objs).where(_live(revoked, deprecated) & F.col("ref").isNotNull())
    groups = known.where("type = 'intrusion-set'").select(F.col("id").alias("source_ref"), F.col("ref").alias("group_id"), F.coalesce("name", "ref").alias("group_name"))
    phases = F.transform(F.filter("kill_chain_phases", lambda p: (p["kill_chain_name"] == "mitre-attack") & (F.coalesce(p["phase_name"], F.lit("")) != "")), lambda p: p["phase_name"])
    unknown = F.array(F.lit("unspecified"))
    techniques = known.where("type = 'attack-pattern'").select(F.col("id").alias("target_ref"), F.col("ref").alias("technique"), F.explode(F.when(F.size(F.coalesce(phases, F.array().cast("array<string>"))) > 0, phases).otherwise(unknown)).alias("tactic"))
    rels = objs.where("type = 'relationship' and relationship_type = 'uses'").select("source_ref", "target_ref")
    return rels.join(groups, "source_ref").join(techniques, "target_ref").select("group_id", "group_name", "tactic", "technique").distinct()

"""Chunks as the JSON payloads that points of a store carry, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.access import SOURCE_TYPES, TLP

# A payload's fields, and what a missing one means.
FIELDS = {
    "chunk_id": "string", "doc_id": "string", "ordinal": "int", "text": "string", "title": "string", "source_type": "string", "source_ref": "string",
    "url": "string", "tlp": "string", "trust_tier": "int", "metadata": "map<string,string>",
}
DEFAULTS = {"chunk_id": "", "doc_id": "", "ordinal": 0, "text": "", "title": "", "source_type": "attack_cti", "source_ref": "", "tlp": "clear", "trust_tier": 0}


def to_payload(chunks: DataFrame, *, nulls: bool = True) -> DataFrame:
    """chunk_id and payload, a JSON object of a chunk's fields; columns that chunks lacks are left out, and without nulls so are null ones. Other columns are ignored."""
    held = [F.col(c).cast(kind).alias(c) for c, kind in FIELDS.items() if c in chunks.columns]
    return chunks.select("chunk_id", F.to_json(F.struct(*held), {"ignoreNullFields": str(not nulls).lower()}).alias("payload"))


def _known(field: Column, name: str, values: tuple[str, ...]) -> Column:
    return F.when(field.isin(*values), field).otherwise(F.raise_error(F.concat(F.lit(f"unknown {name} in a payload: "), field)).cast("string"))


def from_payload(points: DataFrame) -> DataFrame:
    """points(payload) as chunks. Missing and null fields get DEFAULTS, an address stays null, metadata is an empty map; a null payload has no fields.

    Unknown source types and classifications, and payloads that are no JSON object of these
    types, are errors: a default there would declassify a chunk. Fields beyond FIELDS are dropped.
    """
    schema = ", ".join(f"{c} {kind}" for c, kind in FIELDS.items())
    p = points.select(F.from_json(F.coalesce("payload", F.lit("{}")), schema, {"mode": "FAILFAST"}).alias("p"))
    of = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(DEFAULTS[c])) if c in DEFAULTS else F.col(f"p.{c}")
    checked = {"source_type": _known(of("source_type"), "source type", SOURCE_TYPES), "tlp": _known(of("tlp"), "classification", TLP), "metadata": F.coalesce("p.metadata", F.create_map().cast("map<string,string>"))}
    return p.select(*(checked.get(c, of(c)).alias(c) for c in FIELDS))

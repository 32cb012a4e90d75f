"""Classification and row access: one predicate, applied before any ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classifications in rising order, and trust tiers from most to least trusted.
TLP = ("clear", "green", "amber", "red")
AUTHORITATIVE, VENDOR, COMMUNITY, UNTRUSTED = range(4)
SOURCE_TYPES = ("attack_cti", "internal_note", "nvd_cve", "vendor_report", "synthetic_adversarial")


@dataclass(frozen=True)
class Principal:
    """Who asks. allowed_source_types None allows all; an empty list allows none."""

    id: str
    role: str = "analyst"
    clearance: str = "clear"
    allowed_source_types: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.clearance not in TLP:
            raise ValueError(f"unknown clearance {self.clearance!r}")

    @property
    def rank(self) -> int:
        return TLP.index(self.clearance)


def principal_by_id(known: dict[str, Principal], name: str) -> Principal:
    """An unknown principal is an error, never a default."""
    if name not in known:
        raise KeyError(f"unknown principal {name!r}")
    return known[name]


def tlp_rank(tlp: Column) -> Column:
    """Rank of a classification; null for an unknown one, which no clearance reads."""
    return F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(TLP) for x in (t, i))), F.lower(tlp))


def may_read(principal: Principal | None) -> Column:
    if principal is None:
        return F.lit(True)
    ok = F.coalesce(F.col("tlp_rank") <= principal.rank, F.lit(False))
    if principal.allowed_source_types is not None:
        allowed = principal.allowed_source_types
        ok = ok & (F.coalesce(F.col("source_type").isin(*allowed), F.lit(False)) if allowed else F.lit(False))
    return ok


def visible(df: DataFrame, principal: Principal | None) -> DataFrame:
    """Rows (tlp_rank, source_type) that the principal may read; without a principal, all."""
    return df if principal is None else df.where(may_read(principal))

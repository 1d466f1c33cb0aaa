"""Enrichment of the whole property table: coordinates first, then what needs them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plotwise.operators import area_records, lookups, spatial
from plotwise.session import materialise

EPC_COLUMNS = ("epc_rating", "epc_score", "epc_environment_impact", "estimated_energy_cost")
PROXIMITY_COLUMNS = tuple(
    c for t in spatial.TARGETS.values()
    for c in (t.distance, t.name, t.detail, t.within[0] if t.within else None) if c
)


@dataclass(frozen=True)
class ReferenceData:
    """What is at hand; a part left out is skipped."""

    postcode_lookup: DataFrame | None = None
    poi: DataFrame | None = None
    imd: DataFrame | None = None
    broadband: DataFrame | None = None
    certificates: DataFrame | None = None
    flood_areas: DataFrame | None = None
    flood_warnings: DataFrame | None = None


def _keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumnRenamed("property_id", "id")


def enrich(properties: DataFrame, reference: ReferenceData,
           targets: Sequence[str] = tuple(spatial.TARGETS)) -> DataFrame:
    """Next version of the property table; only missing facts are filled."""
    rows = properties
    if reference.postcode_lookup is not None:
        rows = lookups.geocode(rows, reference.postcode_lookup)
        if reference.imd is not None:
            rows = lookups.with_imd(rows, reference.postcode_lookup, reference.imd)
    if reference.broadband is not None:
        rows = lookups.with_broadband(rows, reference.broadband)
    if reference.poi is not None:
        # The points feed several joins and the table joins back: settle it once.
        rows = materialise(rows, "located-properties")
        facts = spatial.proximity(spatial.distinct_points(rows), reference.poi, targets)
        facts = facts.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
        columns = [c for c in PROXIMITY_COLUMNS if c in facts.columns]
        rows = lookups.fill_missing(rows, facts, ["latitude", "longitude"], columns)
    if reference.certificates is not None:
        matched = _keyed(lookups.match_epc(rows, reference.certificates))
        rows = lookups.fill_missing(rows, matched, ["id"], EPC_COLUMNS)
    if reference.flood_areas is not None and reference.flood_warnings is not None:
        postcodes = rows.where(F.col("postcode").isNotNull()).select("postcode").distinct()
        risk = area_records.flood_risk(postcodes, reference.flood_areas, reference.flood_warnings)
        risk = risk.select("postcode", F.col("risk_level").alias("flood_risk_level"))
        rows = lookups.fill_missing(rows, risk, ["postcode"], ["flood_risk_level"])
    return rows

"""Topology correction of the harmonized layer, with its buildings and its effect on matches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.geometry import is_empty
from plotweave.operators.harmonize import apply_edits
from plotweave.operators.reconcile import impact
from plotweave.operators.topology import correct_topology, snap_buildings
from plotweave.session import cut
from plotweave.sources.writers import nan_to_null


class Corrected(NamedTuple):
    """Corrected parcels with all their columns, one-row summary, fixes, issues, buildings (or None), effect on matches."""

    layer: DataFrame
    summary: DataFrame
    fixes: DataFrame
    issues: DataFrame
    buildings: DataFrame | None
    impact: DataFrame


def correct_harmonized(
    harmonized: DataFrame,
    matches: DataFrame,
    buildings: DataFrame | None = None,
    superseded: DataFrame | None = None,
    custom: DataFrame | None = None,
    order: Column | None = None,
    **options,
) -> Corrected:
    """Edits applied, one row per parcel, topology corrected, buildings snapped to the new boundary.

    A parcel with several matches keeps the row of its best one. ``order`` ranks parcels
    for the correction, by default a hash of the id. ``options`` go to ``correct_topology``.
    """
    if custom is not None:
        harmonized = apply_edits(harmonized, superseded, custom)
    key = [c for c in ("dataset_id", "parcel_id") if c in harmonized.columns]
    others = [c for c in harmonized.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct("confidence", "harmonized_id"))
    parcels = harmonized.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")
    parcels = parcels.withColumn("idx", F.xxhash64(*key) if order is None else order)
    parcels = cut(parcels.where(~is_empty("geom")))
    # One name per parcel within the layer; ids may repeat between datasets.
    name = F.col("parcel_id") if key == ["parcel_id"] else F.concat_ws("\0", F.col("dataset_id").cast("string"), "parcel_id")
    shapes = parcels.select(name.alias("feature_id"), "idx", "geom")
    now, summary, fixes, issues = correct_topology(shapes, **options)
    moved = now.where(~is_empty("geom")).select(F.col("feature_id").alias("_name"), "geom")
    layer = nan_to_null(parcels.withColumn("_name", name).drop("geom").join(moved, "_name").drop("_name"))
    snapped = None
    if buildings is not None:
        numbered = buildings if "idx" in buildings.columns else buildings.withColumn("idx", F.xxhash64("dataset_id", "feature_id"))
        snapped = snap_buildings(numbered, layer.select("geom", "idx"))
    return Corrected(layer, summary, fixes, issues, snapped, impact(matches, summary))

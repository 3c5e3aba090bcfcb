"""Footprints outside their parcels and parcels inside right-of-way buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import METRES_PER_DEGREE, area, area_local_m2, bbox, local_m2
from plotweave.operators.spatial_join import corridor_pairs, intersecting

# Severity limits in square metres.
CRITICAL_M2 = 50.0
HIGH_M2 = 20.0
MINIMUM_M2 = 0.01


def _status(area_m2: Column, permissible: float) -> tuple[Column, Column]:
    status = F.when(area_m2 <= permissible, "permissible").otherwise("flagged")
    severity = (
        F.when(area_m2 > CRITICAL_M2, "critical")
        .when(area_m2 > HIGH_M2, "high")
        .when(area_m2 > permissible, "medium")
        .otherwise("low")
    )
    return status, severity


def encroachments(
    parcels: DataFrame, footprints: DataFrame, permissible_m2: float = 5.0, outline: bool = False
) -> DataFrame:
    """Footprint area outside each parcel it meets, per pair.

    Areas come from the shared-area kernel; the outline is cut only on request.
    Metres use the box of the footprint, whose latitude the outside part shares.
    """
    pairs = intersecting(footprints, parcels)
    pairs = pairs.withColumn("_inter", k.intersection_area("geom_a", "geom_b"))
    pairs = pairs.withColumns({"_drone": area("geom_a"), "_box": bbox("geom_a"), "_parcel": area_local_m2("geom_b")})
    box = [F.col(f"_box.{n}") for n in ("minx", "miny", "maxx", "maxy")]
    outside = local_m2(F.greatest(F.col("_drone") - F.col("_inter"), F.lit(0.0)), *box)
    pairs = pairs.withColumns({"_out": outside, "_in": local_m2("_inter", *box)}).where(F.col("_out") > MINIMUM_M2)
    status, severity = _status(F.col("_out"), permissible_m2)
    extra = [k.subtract("geom_a", "geom_b").alias("geom")] if outline else []
    return pairs.select(
        F.concat_ws("-", F.lit("ENC"), F.col("idx_a").cast("string"), F.col("idx_b").cast("string")).alias("encroachment_id"),
        F.col("feature_b").alias("feature_id_cadastral"),
        F.col("feature_a").alias("feature_id_drone"),
        F.round("_in", 2).alias("intersection_area_sqm"),
        F.round("_out", 2).alias("encroachment_area_sqm"),
        F.round(F.col("_out") / F.greatest(F.col("_parcel"), F.lit(1e-6)) * 100.0, 2).alias("variance_percentage"),
        status.alias("status"),
        severity.alias("severity"),
        *extra,
    )


def totals(metrics: DataFrame) -> DataFrame:
    """Count and area of the flagged rows only."""
    flagged = F.col("status") == "flagged"
    return metrics.agg(
        F.count_if(flagged).alias("total_encroachments"),
        F.round(F.coalesce(F.sum(F.when(flagged, F.col("encroachment_area_sqm"))), F.lit(0.0)), 2).alias("total_area_sqm"),
    )


def dataset_report(features: DataFrame, parcel_dataset: int, footprint_dataset: int, permissible_m2: float = 5.0) -> DataFrame:
    """Encroachments between two stored datasets."""
    return encroachments(
        features.where(F.col("dataset_id") == parcel_dataset),
        features.where(F.col("dataset_id") == footprint_dataset),
        permissible_m2,
    )


def buffered(lines: DataFrame, metres: float, quad_segs: int = 16) -> DataFrame:
    """Corridors grown by ``metres`` (at 111000 m per degree) as polygons."""
    return lines.withColumn("geom", k.buffer(metres / METRES_PER_DEGREE, quad_segs)("geom"))


def row_breaches(
    corridors: DataFrame, parcels: DataFrame, buffer_m: float = 10.0, outline: bool = False
) -> DataFrame:
    """Parcel area inside the right-of-way buffer of each corridor.

    Only the pieces of a corridor near the parcel are grown, pair by pair: a buffer is the
    union of the buffers of its pieces, so a corridor of any length is never one value.
    """
    pairs = corridor_pairs(corridors, parcels, buffer_m / METRES_PER_DEGREE)
    pairs = buffered(pairs.withColumnRenamed("reach", "geom"), buffer_m).withColumnRenamed("geom", "zone")
    rows = pairs.join(parcels.select(F.col("feature_id").alias("parcel_id"), F.col("idx"), "geom"), "parcel_id")
    rows = rows.withColumn("_inter", k.intersection_area("zone", "geom")).where("_inter > 1e-16")
    rows = rows.withColumns({"_box": bbox("geom"), "_zone": bbox("zone")})
    low, high = F.greatest("_box.miny", "_zone.miny"), F.least("_box.maxy", "_zone.maxy")
    breach = local_m2("_inter", F.col("_box.minx"), low, F.col("_box.maxx"), high)
    extra = [k.clip("zone", "geom").alias("geom")] if outline else []
    return rows.select(
        F.concat_ws("-", F.lit("ROW"), F.col("corridor_id").cast("string"), F.col("idx").cast("string")).alias("breach_id"),
        F.col("corridor_id").alias("corridor_feature"),
        F.col("parcel_id").alias("parcel_feature"),
        F.lit(buffer_m).alias("buffer_meters"),
        F.round(breach, 2).alias("breach_area_sqm"),
        *extra,
    )

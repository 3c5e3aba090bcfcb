"""Dashboard aggregates, heat points and hotspot roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.geometry import vertex_centroid
from plotweave.operators.components import proximity_clusters
from plotweave.session import cut

# Severity levels of the dashboard and heat weights.
DASHBOARD_SEVERITIES = ["low", "medium", "high", "critical"]
HEAT_WEIGHTS = {"high": 1.0, "critical": 1.0, "medium": 0.6}
HEAT_DEFAULT = 0.3
RESOLVED = ["resolved", "APPROVED"]


def band_counts(matches: DataFrame) -> DataFrame:
    s = F.col("score")
    return matches.agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count_if(s >= 90).alias("high_confidence"),
        F.count_if((s >= 70) & (s < 90)).alias("review_required"),
        F.count_if(s < 70).alias("unmatched"),
    )


def by_type(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def by_severity(conflicts: DataFrame) -> DataFrame:
    """Counts for every dashboard severity, zero where none occurs."""
    spark = conflicts.sparkSession
    levels = spark.createDataFrame([(s,) for s in DASHBOARD_SEVERITIES], "severity string")
    counts = conflicts.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def resolution(conflicts: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("status").isin(*RESOLVED), F.lit(False))
    return conflicts.agg(
        F.count(F.lit(1)).alias("total_conflicts"),
        F.count_if(done).alias("resolved"),
        F.count_if(~done).alias("unresolved"),
    )


def kpi_summary(
    datasets: DataFrame, matches: DataFrame, conflicts: DataFrame, reviews: DataFrame, harmonized: DataFrame
) -> DataFrame:
    """One row of headline numbers; each input is aggregated to one row and the rows are merged."""
    s = F.col("score")
    done = F.coalesce(F.col("status").isin(*RESOLVED), F.lit(False))
    measures = [
        datasets.agg(F.count(F.lit(1)).alias("total_datasets")),
        matches.agg(
            F.count(F.lit(1)).alias("total_matches"),
            F.count_if(s >= 90).alias("high_confidence_matches"),
            F.count_if((s >= 70) & (s < 90)).alias("review_band_matches"),
            F.count_if(s < 70).alias("low_agreement_matches"),
        ),
        conflicts.agg(
            F.count(F.lit(1)).alias("total_conflicts"),
            F.count_if(done).alias("resolved_conflicts"),
            F.count_if(~done).alias("unresolved_conflicts"),
        ),
        reviews.agg(F.count_distinct("conflict_id").alias("total_reviews")),
        harmonized.agg(F.count(F.lit(1)).alias("total_harmonized_parcels")),
    ]
    merged = measures[0]
    for m in measures[1:]:
        merged = merged.unionByName(m, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def quality_indices(evidence: DataFrame) -> DataFrame:
    """Mean of each evidence component and of their mean, as percentages."""
    named = {
        "geometry_alignment_iou": "c_geometry",
        "proximity_euclidean": "c_proximity",
        "area_consistency": "c_area",
        "attribute_concordance": "c_attributes",
    }
    means = [F.avg(c) * 100 for c in named.values()]
    composite = sum(means[1:], means[0]) / len(means)
    return evidence.agg(
        *[F.round(m, 2).alias(n) for n, m in zip(named, means)], F.round(composite, 2).alias("composite_confidence")
    )


def screen_counts(conflicts: DataFrame) -> DataFrame:
    """Counts shown on the review screens."""
    return conflicts.agg(
        F.count_if(F.col("score") >= 90).alias("matched"),
        F.count_if((F.col("score") >= 70) & (F.col("score") < 90)).alias("review"),
        F.count_if(F.col("status").isin(*RESOLVED)).alias("resolved"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
        F.count_if(F.col("status") == "pending_review").alias("pending"),
    )


def _severity() -> Column:
    return F.coalesce(F.lower(F.col("severity")), F.lit("medium"))


def heat_points(conflicts: DataFrame, order: str = "conflict_id") -> DataFrame:
    """Weighted points for a heat map; conflicts without a centre are left out.

    The id carries the conflict's own number, which does not shift when others vanish.
    """
    weight = F.lit(HEAT_DEFAULT)
    for level, w in HEAT_WEIGHTS.items():
        weight = F.when(_severity() == level, w).otherwise(weight)
    return (
        conflicts.withColumn("_c", vertex_centroid("geom"))
        .where("_c is not null")
        .select(
            F.concat(F.lit("HEAT-"), F.col(order)).alias("heat_id"),
            F.col(order).alias("conflict_id"),
            F.round("_c.x", 6).alias("lon"),
            F.round("_c.y", 6).alias("lat"),
            _severity().alias("severity"),
            weight.alias("weight"),
        )
    )


def hotspots(conflicts: DataFrame, eps_km: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(clusters, affected): conflict clusters, and every parcel each of them affects.

    conflicts: (conflict_id, lat, lon, severity, feature_a, feature_b). A cluster has mean
    centre, count, worst severity and the number of affected parcels. ``affected`` has a
    row (cluster_id, parcel, first_conflict_id) per parcel, so a cluster that holds a large
    share of all conflicts is never gathered into one list.
    """
    clusters = proximity_clusters(conflicts.select(F.col("conflict_id").alias("id"), "lat", "lon"), eps_km)
    rows = cut(conflicts.join(clusters.withColumnRenamed("id", "conflict_id"), "conflict_id"))
    sev = _severity()
    rank = F.when(sev.isin("critical", "high"), 3).when(sev == "medium", 2).otherwise(1)
    totals = rows.groupBy("cluster").agg(
        F.min("conflict_id").alias("cluster_id"),
        F.round(F.avg("lon"), 6).alias("center_lon"),
        F.round(F.avg("lat"), 6).alias("center_lat"),
        F.count(F.lit(1)).alias("conflict_count"),
        F.max(rank).alias("_rank"),
    )
    mentions = rows.select("cluster", "conflict_id", F.explode(F.array("feature_a", "feature_b")).alias("parcel"))
    seen = mentions.where("parcel is not null").groupBy("cluster", "parcel").agg(F.min("conflict_id").alias("first_conflict_id"))
    seen = cut(seen)
    level = F.when(F.col("_rank") == 3, "high").when(F.col("_rank") == 2, "medium").otherwise("low")
    counted = totals.join(seen.groupBy("cluster").agg(F.count(F.lit(1)).alias("affected_count")), "cluster", "left")
    spots = counted.select(
        "cluster", "cluster_id", "center_lon", "center_lat", "conflict_count", level.alias("severity"),
        F.coalesce("affected_count", F.lit(0)).alias("affected_count"),
    )
    affected = seen.join(totals.select("cluster", "cluster_id"), "cluster").select("cluster_id", "parcel", "first_conflict_id")
    return spots.drop("cluster"), affected

"""Geometry validation and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import is_empty

# Issue codes and reasons.
EMPTY = ("empty_geometry", "Empty geometry")
INVALID = ("invalid_geometry", "Invalid geometry (e.g. self-intersection)")
UNREPAIRABLE = "unrepairable_geometry"
NOT_VALID = "Geometry could not be made valid"
CRS_MISSING = "crs_missing"
FILE_UNREADABLE = "file_unreadable"


def _judged(df: DataFrame) -> DataFrame:
    """Add ``_empty`` and ``_valid``; the kernel checks rings, closure and self-contact per feature."""
    return df.withColumn("_empty", is_empty("geom")).withColumn(
        "_valid", F.coalesce(k.is_valid("geom"), F.lit(False))
    )


def judged(df: DataFrame) -> DataFrame:
    """``df`` with the issue of each row: ``code`` and ``reason``, null for a valid geometry."""
    rows = _judged(df)

    def told(place: int):
        return F.when(F.col("_empty"), EMPTY[place]).when(~F.col("_valid"), INVALID[place])

    return rows.withColumn("code", told(0)).withColumn("reason", told(1)).drop("_empty", "_valid")


def validate(df: DataFrame) -> DataFrame:
    """Issue rows (dataset_id, feature_index, reason, code)."""
    bad = _judged(df).where("_empty or not _valid")
    return bad.select(
        "dataset_id",
        "feature_index",
        F.when(F.col("_empty"), EMPTY[1]).otherwise(INVALID[1]).alias("reason"),
        F.when(F.col("_empty"), EMPTY[0]).otherwise(INVALID[0]).alias("code"),
    )


def validation_report(df: DataFrame) -> DataFrame:
    """Per dataset: features, issues by code, verdict and resulting status."""
    rows = _judged(df).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.count_if("_empty").alias("empty_geometry"),
        F.count_if(~F.col("_empty") & ~F.col("_valid")).alias("invalid_geometry"),
    )
    valid = (F.col("empty_geometry") + F.col("invalid_geometry")) == 0
    return rows.withColumn("valid", valid).withColumn("status", F.when(valid, "validated").otherwise("invalid"))


def repair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept features with ``repaired`` flag, issue rows for dropped ones).

    Only invalid rows go through the even-odd rebuild; valid rows pass untouched.
    """
    judged = _judged(df)
    invalid = ~F.col("_empty") & ~F.col("_valid")
    fixed = judged.withColumn("_fixed", k.make_valid(F.when(invalid, F.col("geom"))))
    kept = fixed.where(~F.col("_empty") & (F.col("_valid") | F.col("_fixed").isNotNull()))
    kept = kept.withColumn("repaired", ~F.col("_valid")).withColumn(
        "geom", F.when(F.col("_valid"), F.col("geom")).otherwise(F.col("_fixed"))
    )
    dropped = fixed.where(F.col("_empty") | (invalid & F.col("_fixed").isNull())).select(
        "dataset_id",
        "feature_index",
        F.when(F.col("_empty"), EMPTY[1]).otherwise(NOT_VALID).alias("reason"),
        F.lit(UNREPAIRABLE).alias("code"),
    )
    return kept.drop("_empty", "_valid", "_fixed"), dropped


def repair_report(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per dataset: kept, dropped and repaired counts."""
    a = kept.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("feature_count"), F.count_if("repaired").alias("repaired_count")
    )
    b = dropped.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("dropped_count"))
    return a.join(b, "dataset_id", "full").fillna(0)

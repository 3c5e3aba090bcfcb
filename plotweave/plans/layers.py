"""Feature layers the registered queries start from, and the matching oracle fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.geometry import area_local_m2
from plotweave.sources.fixtures import layer, view

# Square metres of a rectangle row (x0, y0, x1, y1) in oracle SQL.
RECT_M2 = "((x1-x0)*(y1-y0)*12321000000e0*cos(radians((y0+y1)/2)))"
FIXED_M2 = "12321000000e0*cos(radians(28.6e0))"


def cadastral(spark: SparkSession, sf: str) -> DataFrame:
    df = layer(spark, sf, "fx_cadastral").withColumnRenamed("k", "idx")
    return df.withColumns(
        {"area": area_local_m2("geom"), "source_reliability": F.lit(95), "dataset_id": F.lit(1)}
    )


def municipal(spark: SparkSession, sf: str) -> DataFrame:
    df = layer(spark, sf, "fx_municipal").withColumnRenamed("k", "idx")
    return df.withColumns(
        {
            "area": area_local_m2("geom") * F.col("area_factor"),
            "source_reliability": F.lit(82),
            "dataset_id": F.lit(2),
        }
    )


def buildings(spark: SparkSession, sf: str) -> DataFrame:
    return layer(spark, sf, "fx_building")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Both parcel layers under one schema."""
    return cadastral(spark, sf).unionByName(municipal(spark, sf), allowMissingColumns=True).hint("merge")


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_match")


FEATURES_SQL = f"""features AS (
  SELECT feature_id, 1 AS dataset_id, 95 AS rel, {RECT_M2} AS area, owner, land_use FROM fx_cadastral
  UNION ALL
  SELECT feature_id, 2, 82, {RECT_M2} * area_factor, NULL, land_use FROM fx_municipal)"""

"""Deterministic parcel layers derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both accept, so a query and its oracle
start from the same rows at any scale factor. Every row of a table is used; parcels that
shall lack a counterpart have it moved away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.geometry import line, point, rect
from plotweave.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "fx_cadastral": """
SELECT k, concat('P-', CAST(k AS VARCHAR(20))) AS feature_id,
  77.2e0 + c*0.001e0 AS x0, 28.6e0 + r*0.001e0 AS y0,
  77.2e0 + (c+1)*0.001e0 + CASE WHEN k%21=0 THEN 0.00002e0 WHEN k%7=0 THEN 0.000005e0
                               WHEN k%11=0 THEN -0.000003e0 ELSE 0e0 END AS x1,
  28.6e0 + (r+1)*0.001e0 AS y1,
  p_type AS land_use, p_brand AS owner, p_name AS name,
  CASE WHEN k%4=0 THEN CAST(k%97 AS VARCHAR(20)) END AS khasra_no
FROM (SELECT *, p_partkey AS k, p_partkey%50 AS c, (p_partkey - p_partkey%50)/50 AS r FROM part) t
""",
    "fx_municipal": """
SELECT k, concat('M-', CAST(k AS VARCHAR(20))) AS feature_id,
  77.2e0 + c*0.001e0 + dx AS x0, 28.6e0 + r*0.001e0 + dy AS y0,
  77.2e0 + (c+1)*0.001e0 + dx AS x1, 28.6e0 + (r+1)*0.001e0 + dy AS y1,
  CASE WHEN k%5=0 THEN 'MIXED USE' ELSE p_type END AS land_use, p_brand AS zone,
  CASE WHEN k%8=0 THEN CAST(k%97 AS VARCHAR(20)) END AS khasra_no,
  CASE WHEN k%6=0 THEN 1.05e0 ELSE 1e0 END AS area_factor
FROM (SELECT *, p_partkey AS k, p_partkey%50 AS c, (p_partkey - p_partkey%50)/50 AS r,
        ((p_partkey*37)%21 - 10)*0.000001e0 AS dx, ((p_partkey*53)%21 - 10)*0.000001e0
        + CASE WHEN p_partkey%10 = 3 THEN 3e0 ELSE 0e0 END AS dy
      FROM part) t
""",
    "fx_building": """
SELECT d AS dataset_id, concat('B', CAST(d AS VARCHAR(20)), '-', CAST(k AS VARCHAR(20))) AS feature_id,
  77.2e0 + c*0.001e0 + 0.0002e0 + (d-1)*0.00001e0 AS x0, 28.6e0 + r*0.001e0 + 0.0002e0 AS y0,
  77.2e0 + c*0.001e0 + 0.0006e0 + (d-1)*0.00001e0 AS x1, 28.6e0 + r*0.001e0 + 0.0006e0 AS y1
FROM (SELECT c_custkey AS k, c_custkey%50 AS c,
        (c_custkey - c_custkey%50)/50 + CASE WHEN d = 2 AND c_custkey%9 = 0 THEN 3000 ELSE 0 END AS r, d
      FROM customer CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 2 AS d) s) t
""",
    "fx_footprint": """
SELECT k, concat('D-', CAST(k AS VARCHAR(20))) AS feature_id,
  77.2e0 + c*0.001e0 + 0.0001e0 AS x0, 28.6e0 + r*0.001e0 + 0.0001e0 AS y0,
  77.2e0 + (c+1)*0.001e0 + CASE WHEN k%15=0 THEN 0.00005e0 ELSE 0.0000003e0 END AS x1,
  28.6e0 + (r+1)*0.001e0 - 0.0001e0 AS y1
FROM (SELECT p_partkey AS k, p_partkey%50 AS c, (p_partkey - p_partkey%50)/50 AS r FROM part) t
""",
    "fx_corridor": """
SELECT r_regionkey AS corridor_id, 77.19e0 AS xa, 28.6005e0 + r_regionkey*0.002e0 AS ya,
  77.26e0 AS xb, 28.6005e0 + r_regionkey*0.002e0 AS yb FROM region
""",
    "fx_point_row": """
SELECT event_id AS row_id,
  CASE WHEN event_id%3=0 THEN 77e0 + (event_id%1000)*0.0001e0 ELSE 28e0 + (user_id%1000)*0.0001e0 END AS lat,
  CASE WHEN event_id%3=0 THEN 28e0 + (user_id%1000)*0.0001e0 ELSE 77e0 + (event_id%1000)*0.0001e0 END AS lon
FROM events
""",
    "fx_conflict_point": """
SELECT c_custkey AS conflict_id,
  77e0 + ((c_custkey*7919)%10007)*0.0001e0 AS lon, 28e0 + ((c_custkey*104729)%10007)*0.0001e0 AS lat,
  CASE WHEN c_custkey%7=0 THEN 'high' WHEN c_custkey%3=0 THEN 'medium' ELSE 'low' END AS severity
FROM customer
""",
    "fx_review": """
SELECT user_id AS conflict_id, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit'
                  WHEN 'view' THEN 'flagged' ELSE 'APPROVED' END AS decision
FROM events
""",
    "fx_area_text": """
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber%8
    WHEN 0 THEN concat(q, ' Bigha ', q, ' Biswa') WHEN 1 THEN concat(q, ' Bigha') WHEN 2 THEN concat(q, ' Biswa')
    WHEN 3 THEN concat(q, ' Guntha') WHEN 4 THEN concat(q, ' Kanal') WHEN 5 THEN concat(q, ' sqm')
    WHEN 6 THEN concat(q, '.5 बीघा') ELSE concat('n/a ', q) END AS raw_area
FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) AS q FROM lineitem) t
""",
    "fx_way_node": """
SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey AS node_id FROM lineitem
""",
    "fx_node": """
SELECT p_partkey AS node_id, 77e0 + (p_partkey%100)*0.001e0 AS lon,
  28e0 + ((p_partkey*31)%100)*0.001e0 AS lat FROM part WHERE p_partkey%50 <> 7
""",
    "fx_source": """
SELECT n_nationkey AS source_id, n_name AS name, concat('Authority ', CAST(n_regionkey AS VARCHAR(20))) AS authority,
  60e0 + (n_nationkey*7)%40 AS reliability_score FROM nation
""",
    "fx_dataset": """
SELECT s_suppkey AS id, CASE WHEN s_suppkey%4=0 THEN NULL ELSE s_nationkey END AS source_id,
  CASE s_suppkey%3 WHEN 0 THEN 'cadastral' WHEN 1 THEN 'municipal' ELSE 'building' END AS dataset_type,
  concat('uploads/', s_name, '.geojson') AS file_path FROM supplier
""",    "fx_match": """
SELECT concat('P-', CAST(k AS VARCHAR(20))) AS feature_a, concat('M-', CAST(k+o AS VARCHAR(20))) AS feature_b,
  CAST((k*7919 + o*31)%101 AS INT) AS score,
  CASE WHEN (k*7919 + o*31)%101 >= 90 THEN 'matched' WHEN (k*7919 + o*31)%101 >= 70 THEN 'review'
       ELSE 'unmatched' END AS status
FROM (SELECT p_partkey AS k, o FROM part CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 AS o) s) t
""",
}

# Views whose rows make much work in later steps, and the column that deals them out.
SPREAD = dict.fromkeys(("fx_cadastral", "fx_municipal", "fx_building", "fx_footprint"), "feature_id") | {"fx_match": "feature_a"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, read from the parquet tables under ``sf_dir``."""
    for table in TABLES:
        if f" {table}" in VIEWS[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    rows = spark.sql(VIEWS[name])
    return spread(rows, SPREAD[name]) if name in SPREAD else rows


def with_sql(names: str, body: str) -> str:
    """Oracle text: the named views as common table expressions, then ``body``."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names.split())
    return f"WITH {ctes}{' ' if body.lstrip().startswith(',') else chr(10)}{body}"


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rectangle view as a feature layer: the polygon in ``geom`` replaces the four bounds."""
    df = view(spark, sf_dir, name).withColumn("geom", rect("x0", "y0", "x1", "y1"))
    return df.drop("x0", "y0", "x1", "y1")


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "fx_corridor")
    return df.select("corridor_id", line(point("xa", "ya"), point("xb", "yb")).alias("geom"))

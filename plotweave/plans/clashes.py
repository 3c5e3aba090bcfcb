"""Queries on layers whose ids repeat between datasets, and queues with a limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions.geometry import rect
from plotweave.operators import components as cc
from plotweave.operators import harmonize as hz
from plotweave.operators import reconcile as rc
from plotweave.operators import spatial_join as sj
from plotweave.plans import layers as ly
from plotweave.plans.registry import query
from plotweave.sources.fixtures import with_sql


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "a7_groups_by_dataset",
    """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderkey % 100 >= 70),
    g AS (SELECT c, count(*) AS n FROM e GROUP BY c), m AS (SELECT DISTINCT c, 'customer' AS d, c AS f FROM e UNION ALL SELECT c, 'order', o FROM e)
    SELECT 'customer' AS group_dataset, m.c AS group_id, m.d AS dataset_id, m.f AS feature_id, CAST(g.n + 1 AS INT) AS member_count, g.n AS pair_count,
      CASE WHEN g.n >= 2 THEN 'clustered' ELSE 'partial_group' END AS status FROM m JOIN g ON g.c = m.c""",
)
def a7_groups(spark, sf):
    """Customers and their orders are numbered alike: only the dataset tells their ids apart."""
    pairs = _table(spark, sf, "orders").select(
        F.lit("customer").alias("dataset_a"), F.col("o_custkey").cast("string").alias("feature_a"),
        F.lit("order").alias("dataset_b"), F.col("o_orderkey").cast("string").alias("feature_b"), (F.col("o_orderkey") % 100).alias("score"),
    )
    groups, members = cc.match_groups(pairs)
    return groups.join(members, ["group_dataset", "group_id"])


IMPACTS = """WITH p AS (SELECT CAST(l_suppkey % 3 AS INT) AS dataset_a, CAST(l_partkey AS VARCHAR) AS feature_a, CAST(3 + l_suppkey % 2 AS INT) AS dataset_b,
      CAST(l_orderkey AS VARCHAR) AS feature_b, CAST(l_quantity AS BIGINT) * 2 AS score FROM lineitem),
    s AS (SELECT *, CASE WHEN score >= 90 THEN 'matched' WHEN score >= 70 THEN 'review' ELSE 'unmatched' END AS status FROM p),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_a, feature_a ORDER BY score, feature_b DESC, dataset_b DESC) AS n FROM s) t WHERE n = 1)"""


@query(
    "w6_last_pair_by_dataset",
    IMPACTS
    + """SELECT dataset_a, feature_a, dataset_b, feature_b, score AS score_before, least(99e0, round(score + 9.6e0, 1)) AS score_after,
      status AS status_before, CASE WHEN least(99e0, round(score + 9.6e0, 1)) >= 75 THEN 'matched' ELSE status END AS status_after FROM m""",
)
def w6_by_dataset(spark, sf):
    """The topology impact on parts numbered alike in three datasets."""
    score = F.col("l_quantity").cast("long") * 2
    pairs = _table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 3).cast("int").alias("dataset_a"), F.col("l_partkey").cast("string").alias("feature_a"),
        (3 + F.col("l_suppkey") % 2).cast("int").alias("dataset_b"), F.col("l_orderkey").cast("string").alias("feature_b"), score.alias("score"),
    )
    status = F.when(F.col("score") >= 90, "matched").when(F.col("score") >= 70, "review").otherwise("unmatched")
    counts = {"vertices_snapped": 4, "overlaps_resolved": 1, "gaps_resolved": 0, "slivers_cleaned": 2}
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in counts.items()])
    return rc.impact(pairs.withColumn("status", status), one).drop("fixes_applied")


@query(
    "j13_edits_by_dataset",
    """WITH h AS (SELECT 'customer' AS dataset_id, CAST(c_custkey AS VARCHAR) AS parcel_id FROM customer
      UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier)
    SELECT dataset_id, parcel_id FROM h WHERE NOT (dataset_id = 'customer' AND parcel_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 12))
      AND NOT (dataset_id = 'supplier' AND parcel_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey >= 12))
    UNION ALL SELECT 'region', concat('NEW-', CAST(r_regionkey AS VARCHAR)) FROM region""",
)
def j13_by_dataset(spark, sf):
    """Superseding customers leaves suppliers of the same number alone, and the other way round."""

    def parcels(table, name, key):
        rows = _table(spark, sf, table).select(F.lit(name).alias("dataset_id"), F.col(key).cast("string").alias("parcel_id"), F.col(f"{key[0]}_nationkey").alias("n"))
        return rows.withColumn("harmonized_id", F.concat(F.lit("HARM-"), "parcel_id"))

    c, s = parcels("customer", "customer", "c_custkey"), parcels("supplier", "supplier", "s_suppkey")
    gone = c.where("n < 12").unionByName(s.where("n >= 12")).select("dataset_id", "parcel_id")
    name = F.concat(F.lit("NEW-"), F.col("r_regionkey").cast("string"))
    new = _table(spark, sf, "region").select(F.lit("region").alias("dataset_id"), name.alias("parcel_id"))
    return hz.apply_edits(c.unionByName(s).drop("n"), gone, new).select("dataset_id", "parcel_id")


@query(
    "j14_absence_by_dataset",
    """WITH a AS (SELECT 'customer' AS dataset_id, CAST(c_custkey AS VARCHAR) AS feature_id, c_custkey % 97 / 97e0 AS cx, c_nationkey / 25e0 AS cy, c_nationkey AS n FROM customer
      UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_suppkey % 97 / 97e0, s_nationkey / 25e0, s_nationkey FROM supplier)
    SELECT dataset_id, feature_id, CASE WHEN cx BETWEEN 0.205e0 AND 0.705e0 AND cy BETWEEN 0.11e0 AND 0.91e0 THEN 'real_gap' ELSE 'expected_absence' END AS absence
    FROM a WHERE NOT (dataset_id = 'customer' AND n % 2 = 0 OR dataset_id = 'supplier' AND n % 2 = 1)""",
)
def j14_by_dataset(spark, sf):
    """Absence of customers and suppliers numbered alike, of which different ones have a partner."""

    def points(table, name, key):
        x, y = F.col(key) % 97 / 97.0, F.col(f"{key[0]}_nationkey") / 25.0
        return _table(spark, sf, table).select(
            F.lit(name).alias("dataset_id"), F.col(key).cast("string").alias("feature_id"), x.alias("cx"), y.alias("cy"), F.col(f"{key[0]}_nationkey").alias("n")
        )

    c, s = points("customer", "customer", "c_custkey"), points("supplier", "supplier", "s_suppkey")
    near = c.where("n % 2 = 0").unionByName(s.where("n % 2 = 1")).select(F.col("dataset_id").alias("dataset_a"), F.col("feature_id").alias("feature_a"))
    box = spark.range(1).select(F.lit(0.205).alias("x0"), F.lit(0.11).alias("y0"), F.lit(0.705).alias("x1"), F.lit(0.91).alias("y1"))
    return sj.expected_absence(c.unionByName(s), near, box.select(rect("x0", "y0", "x1", "y1").alias("geom")))


@query(
    "w1_fair_share_of_forty",
    with_sql(
        "fx_building",
        """SELECT dataset_id, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY feature_id) AS n FROM fx_building) t WHERE n <= 40""",
    ),
)
def w1_forty(spark, sf):
    return rc.limit_per_dataset(ly.buildings(spark, sf), 40).select("dataset_id", "feature_id")


@query(
    "w3_best_fifty_of_each",
    with_sql(
        "fx_match",
        """, c AS (SELECT feature_a, feature_b, score, 'cadastral' AS queue_kind FROM fx_match ORDER BY score DESC, feature_a, feature_b LIMIT 50),
        b AS (SELECT concat('B1-', feature_a) AS feature_a, concat('B2-', feature_b) AS feature_b, 100 - score AS score, 'building' AS queue_kind
          FROM fx_match ORDER BY 100 - score DESC, 1, 2 LIMIT 50)
        SELECT * FROM c UNION ALL SELECT * FROM b""",
    ),
)
def w3_fifty(spark, sf):
    c = ly.matches(spark, sf).drop("status")
    b = c.select(
        F.concat(F.lit("B1-"), "feature_a").alias("feature_a"), F.concat(F.lit("B2-"), "feature_b").alias("feature_b"), (100 - F.col("score")).alias("score")
    )
    return rc.balanced_queue(c, b, 50)

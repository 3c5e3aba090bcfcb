"""Queries on conflicts, recommendations, reviews, windows and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions.geometry import point_geometry, shift_m, vertex_centroid
from plotweave.operators import analytics as an
from plotweave.operators import components as cc
from plotweave.operators import reconcile as rc
from plotweave.operators.harmonize import harmonize
from plotweave.operators.topology import correct_topology
from plotweave.plans import layers as ly
from plotweave.plans.registry import query
from plotweave.sources.fixtures import VIEWS, view, with_sql

CONFLICT_VIEWS = "fx_match fx_cadastral fx_municipal"
CONFLICTS = f""", {ly.FEATURES_SQL},
  joined AS (SELECT m.*, CASE WHEN a.area IS NULL OR b.area IS NULL THEN 0e0 ELSE a.area END AS area_a,
      CASE WHEN a.area IS NULL OR b.area IS NULL THEN 0e0 ELSE b.area END AS area_b
    FROM fx_match m LEFT JOIN features a ON m.feature_a = a.feature_id LEFT JOIN features b ON m.feature_b = b.feature_id),
  typed AS (SELECT *, abs(area_a-area_b) AS area_difference,
      CASE WHEN abs(area_a-area_b) > 10 THEN 'area' WHEN score >= 70 AND score < 90 THEN 'geometry'
           WHEN score < 70 THEN 'missing_feature' END AS type FROM joined),
  conflicts AS (SELECT *, CASE WHEN type = 'missing_feature' THEN 'high' ELSE 'medium' END AS severity,
      CASE type WHEN 'area' THEN printf('Area discrepancy detected: %.1f m² vs %.1f m² (Delta: %.1f m²)', area_a, area_b, area_difference)
        WHEN 'geometry' THEN 'Boundary geometry deviation detected between survey and municipal GIS'
        ELSE 'Feature missing or unaligned in municipal registry' END AS reason,
      row_number() OVER (ORDER BY score DESC, feature_a, feature_b) AS id
    FROM typed WHERE type IS NOT NULL)"""


def conflicts(spark, sf):
    return rc.detect_conflicts(ly.matches(spark, sf), ly.features(spark, sf).select("feature_id", "area"))


def numbered(spark, sf):
    return rc.number_conflicts(conflicts(spark, sf))


def reviews(spark, sf):
    return view(spark, sf, "fx_review")


def reviewed(spark, sf):
    rows = numbered(spark, sf).drop("status").withColumnRenamed("id", "conflict_id")
    return rc.overlay_reviews(rows, reviews(spark, sf))


LATEST = """ latest AS (SELECT conflict_id, CASE WHEN upper(decision) IN ('APPROVED','ACCEPT') THEN 'APPROVED'
    WHEN upper(decision) IN ('REJECTED','REJECT') THEN 'REJECTED'
    WHEN upper(decision) IN ('FLAGGED','FLAG','EDIT') THEN 'FLAGGED' ELSE upper(decision) END AS decision
  FROM (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_review) t WHERE n = 1),
  reviewed AS (SELECT c.*, coalesce(l.decision, 'pending_review') AS state FROM conflicts c LEFT JOIN latest l ON c.id = l.conflict_id)"""
REVIEW_VIEWS = CONFLICT_VIEWS + " fx_review"


@query(
    "r1_simple_conflicts",
    with_sql(
        "fx_match",
        """SELECT feature_a, feature_b, CASE WHEN status='unmatched' THEN 'missing_feature' ELSE 'attribute' END AS type,
        CASE WHEN status='unmatched' THEN 'high' ELSE 'medium' END AS severity FROM fx_match WHERE status <> 'matched'""",
    ),
)
def r1(spark, sf):
    return rc.simple_conflicts(ly.matches(spark, sf))


@query(
    "r2_detect_conflicts",
    with_sql(
        CONFLICT_VIEWS,
        CONFLICTS + "SELECT feature_a, feature_b, type, severity, reason, round(area_difference, 2) AS area_difference, score FROM conflicts",
    ),
)
def r2(spark, sf):
    return conflicts(spark, sf).select(
        "feature_a", "feature_b", "type", "severity", "reason", F.round("area_difference", 2).alias("area_difference"), "score"
    )


@query(
    "r3_check_enums",
    """SELECT o_orderkey AS id, CASE WHEN o_orderpriority NOT LIKE '%H%' THEN 'unsupported conflict type'
        WHEN o_orderstatus = 'P' THEN 'unsupported severity' ELSE 'conflict_id must be non-negative' END AS problem
      FROM (SELECT CASE WHEN o_orderkey%50 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_orderpriority, o_orderstatus FROM orders) t
      WHERE o_orderpriority NOT LIKE '%H%' OR o_orderstatus = 'P' OR o_orderkey < 0""",
)
def r3(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("id"),
        F.when(F.col("o_orderpriority").contains("H"), "area").otherwise("size").alias("type"),
        F.when(F.col("o_orderstatus") == "P", "urgent").otherwise("high").alias("severity"),
    )
    return rc.check_enums(rows)[1].select("id", "problem")


@query(
    "r4_recommend",
    """WITH c AS (SELECT o_orderkey AS id, o_custkey,
        CASE o_orderkey%6 WHEN 0 THEN 'geometry' WHEN 1 THEN 'area' WHEN 2 THEN 'attribute' WHEN 3 THEN 'missing_feature'
          WHEN 4 THEN 'duplicate' ELSE 'temporal' END AS type,
        CASE o_orderkey%4 WHEN 0 THEN 'informational' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity,
        CASE WHEN o_orderkey%3=0 THEN CAST(o_custkey%121 AS INT) END AS score,
        CASE WHEN o_orderkey%5<3 THEN CAST(o_custkey%100 AS DOUBLE) END AS rel_a,
        CASE WHEN o_orderkey%7<5 AND o_orderkey%8<>0 THEN CAST(o_custkey*3%100 AS DOUBLE) END AS rel_b,
        o_orderkey%8<>0 AS has_b FROM orders)
      SELECT id, CASE WHEN type='duplicate' THEN 'manual_review_required' WHEN type='temporal' THEN 'flag_real_world_change'
          WHEN rel_a > rel_b THEN 'prefer_source_a' WHEN rel_b > rel_a THEN 'prefer_source_b'
          WHEN type IN ('attribute','area') THEN 'merge_attributes'
          WHEN type='missing_feature' AND NOT has_b THEN 'prefer_source_a' ELSE 'manual_review_required' END AS action,
        CASE WHEN score IS NOT NULL THEN least(score, 100) WHEN severity='informational' THEN 60 WHEN severity='low' THEN 70
          WHEN severity='medium' THEN 80 ELSE 90 END AS confidence,
        CASE WHEN type IN ('duplicate','temporal') THEN 'Conflict type requires explicit review'
          WHEN rel_a > rel_b THEN 'Source A has the higher reliability score' WHEN rel_b > rel_a THEN 'Source B has the higher reliability score'
          WHEN type IN ('attribute','area') THEN 'Both sources are available and the conflict is attribute-level'
          WHEN type='missing_feature' AND NOT has_b THEN 'The feature is present only in source A'
          ELSE 'Conflict type requires explicit review' END AS reason FROM c""",
)
def r4(spark, sf):
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        k.alias("id"),
        F.element_at(F.array(*map(F.lit, rc.CONFLICT_TYPES)), (k % 6 + 1).cast("int")).alias("type"),
        F.element_at(F.array(*map(F.lit, rc.SEVERITIES)), (k % 4 + 1).cast("int")).alias("severity"),
        F.when(k % 3 == 0, cust % 121).alias("score"),
        F.when(k % 5 < 3, (cust % 100).cast("double")).alias("rel_a"),
        F.when((k % 7 < 5) & (k % 8 != 0), (cust * 3 % 100).cast("double")).alias("rel_b"),
        F.lit(True).alias("has_a"),
        (k % 8 != 0).alias("has_b"),
    )
    return rc.recommend(rows).select("id", "action", "confidence", "reason")


RECOMMENDED = """SELECT feature_a, feature_b, 'prefer_source' AS action, CAST(score AS INT) AS confidence,
    CASE WHEN feature_a LIKE 'P-%' THEN 1 END AS preferred_dataset_id, type, severity FROM conflicts"""


@query("r5_contract_bridge", with_sql(CONFLICT_VIEWS, CONFLICTS + RECOMMENDED))
def r5(spark, sf):
    features = ly.features(spark, sf).select("feature_id", "dataset_id", "source_reliability")
    return rc.bridge(rc.recommend(rc.attach_sides(conflicts(spark, sf), features))).select(
        "feature_a", "feature_b", "action", "confidence", "preferred_dataset_id", "type", "severity"
    )


@query(
    "j11_preferred_source",
    with_sql(
        "fx_source fx_dataset",
        """, r AS (SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS side, o_orderkey%150 AS ds FROM orders)
        SELECT o_orderkey AS id, CASE WHEN side IS NOT NULL THEN coalesce(s.name, CASE side WHEN 'a' THEN 'Primary Source' ELSE 'Secondary Source' END) END
          AS preferred_source_name
        FROM r LEFT JOIN fx_dataset d ON d.id = r.ds AND r.side IS NOT NULL LEFT JOIN fx_source s ON s.source_id = d.source_id""",
    ),
)
def j11(spark, sf):
    k = F.col("o_orderkey")
    side = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        k.alias("id"), side.alias("preferred_side"), F.when(side.isNotNull(), k % 150).alias("preferred_dataset_id")
    )
    named = rc.name_preferred(rows, view(spark, sf, "fx_dataset"), view(spark, sf, "fx_source"))
    return named.select("id", "preferred_source_name")


@query(
    "r6_canonical_decision",
    with_sql(
        "fx_review",
        """SELECT event_id, CASE WHEN upper(decision) IN ('APPROVED','ACCEPT') THEN 'APPROVED'
        WHEN upper(decision) IN ('REJECTED','REJECT') THEN 'REJECTED'
        WHEN upper(decision) IN ('FLAGGED','FLAG','EDIT') THEN 'FLAGGED' ELSE upper(decision) END AS decision FROM fx_review""",
    ),
)
def r6(spark, sf):
    return reviews(spark, sf).select("event_id", rc.canonical_decision("decision").alias("decision"))


@query(
    "w4_latest_review",
    with_sql(
        "fx_review",
        """SELECT conflict_id, event_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY conflict_id
        ORDER BY ts DESC, event_id DESC) AS n FROM fx_review) t WHERE n = 1""",
    ),
)
def w4(spark, sf):
    return rc.latest_reviews(reviews(spark, sf)).select("conflict_id", "event_id", "decision")


@query(
    "j12_review_overlay",
    with_sql(REVIEW_VIEWS, CONFLICTS + "," + LATEST + "SELECT id AS conflict_id, feature_a, feature_b, state AS status FROM reviewed"),
)
def j12(spark, sf):
    return reviewed(spark, sf).select("conflict_id", "feature_a", "feature_b", "status")


@query(
    "w5_numbered_conflicts",
    with_sql(CONFLICT_VIEWS, CONFLICTS + "SELECT id, feature_a, feature_b, type FROM conflicts"),
)
def w5(spark, sf):
    return numbered(spark, sf).select("id", "feature_a", "feature_b", "type")


@query(
    "r7_auto_approve",
    with_sql(
        REVIEW_VIEWS,
        CONFLICTS + "," + LATEST + """SELECT id AS conflict_id, 'APPROVED' AS decision,
        'Auto-approved above confidence threshold 80%' AS comment FROM reviewed WHERE score >= 80 AND state <> 'APPROVED'""",
    ),
)
def r7(spark, sf):
    return rc.auto_approve(reviewed(spark, sf), 80).select("conflict_id", "decision", "comment")


@query(
    "j10_attach_details",
    with_sql(
        CONFLICT_VIEWS,
        f""", {ly.FEATURES_SQL} SELECT m.feature_a, m.feature_b, round(a.area, 2) AS area_a, a.owner AS owner_a,
        round(b.area, 2) AS area_b, b.land_use AS land_use_b FROM fx_match m
        LEFT JOIN features a ON m.feature_a = a.feature_id LEFT JOIN features b ON m.feature_b = b.feature_id""",
    ),
)
def j10(spark, sf):
    rows = rc.attach_details(ly.matches(spark, sf), ly.features(spark, sf).drop("geom"))
    return rows.select(
        "feature_a",
        "feature_b",
        F.round("feature_a_details.area", 2).alias("area_a"),
        F.col("feature_a_details.owner").alias("owner_a"),
        F.round("feature_b_details.area", 2).alias("area_b"),
        F.col("feature_b_details.land_use").alias("land_use_b"),
    )


@query(
    "j15_conflict_areas",
    with_sql(
        CONFLICT_VIEWS,
        CONFLICTS + "SELECT feature_a, feature_b, round(area_a, 2) AS area_a, round(area_b, 2) AS area_b FROM conflicts",
    ),
)
def j15(spark, sf):
    return conflicts(spark, sf).select(
        "feature_a", "feature_b", F.round("area_a", 2).alias("area_a"), F.round("area_b", 2).alias("area_b")
    )


@query(
    "g15_pair_shift",
    with_sql(
        CONFLICT_VIEWS,
        """SELECT m.feature_a, m.feature_b, round(sqrt(pow(((3*b.y0+2*b.y1)/5 - (3*a.y0+2*a.y1)/5)*111139e0, 2)
          + pow(((3*b.x0+2*b.x1)/5 - (3*a.x0+2*a.x1)/5)*111139e0*cos(((3*b.y0+2*b.y1)/5 + (3*a.y0+2*a.y1)/5)/2*pi()/180), 2)), 1) AS shift_m
        FROM fx_match m JOIN fx_cadastral a ON m.feature_a = a.feature_id JOIN fx_municipal b ON m.feature_b = b.feature_id""",
    ),
)
def g15(spark, sf):
    centre = ly.features(spark, sf).select("feature_id", vertex_centroid("geom").alias("v"))
    rows = rc.attach_details(ly.matches(spark, sf), centre)
    a, b = F.col("feature_a_details.v"), F.col("feature_b_details.v")
    return rows.where(a.isNotNull() & b.isNotNull()).select(
        "feature_a", "feature_b", shift_m(a["x"], a["y"], b["x"], b["y"]).alias("shift_m")
    )


@query(
    "t14_match_filter",
    with_sql(
        CONFLICT_VIEWS,
        """SELECT m.feature_a, m.feature_b, m.score FROM fx_match m JOIN fx_cadastral a ON m.feature_a = a.feature_id
        WHERE score >= 70 AND score < 90 AND (contains(lower(m.feature_a), '#1') OR contains(lower(m.feature_b), '#1') OR contains(lower(owner), '#1'))""",
    ),
)
def t14(spark, sf):
    owners = ly.cadastral(spark, sf).select(F.col("feature_id").alias("feature_a"), "owner")
    rows = ly.matches(spark, sf).join(owners, "feature_a")
    return rc.filter_matches(rows, "review", "#1").select("feature_a", "feature_b", "score")


@query(
    "t15_conflict_filter",
    with_sql(CONFLICT_VIEWS, CONFLICTS + "SELECT feature_a, feature_b FROM conflicts WHERE type = 'geometry'"),
)
def t15(spark, sf):
    return conflicts(spark, sf).where("type = 'geometry'").select("feature_a", "feature_b")


@query(
    "w1_fair_share",
    with_sql(
        "fx_building",
        "SELECT dataset_id, feature_id FROM fx_building",
    ),
)
def w1(spark, sf):
    return rc.limit_per_dataset(ly.buildings(spark, sf)).select("dataset_id", "feature_id")


@query(
    "w2_dedupe",
    """SELECT l_suppkey AS dataset_id, concat('F-', CAST(l_partkey AS VARCHAR)) AS feature_id, min(l_orderkey*10 + l_linenumber) AS id
    FROM lineitem GROUP BY 1, 2""",
)
def w2(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("dataset_id"),
        F.concat(F.lit("F-"), F.col("l_partkey")).alias("feature_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )
    return rc.dedupe_features(rows, "id")


@query(
    "w3_balanced_queue",
    with_sql(
        "fx_match",
        """, c AS (SELECT *, 'cadastral' AS queue_kind FROM fx_match), b AS (SELECT concat('B1-', feature_a) AS feature_a,
          concat('B2-', feature_b) AS feature_b, 100 - score AS score, 'building' AS queue_kind FROM fx_match)
        SELECT feature_a, feature_b, score, queue_kind FROM c UNION ALL SELECT feature_a, feature_b, score, queue_kind FROM b""",
    ),
)
def w3(spark, sf):
    c = ly.matches(spark, sf).drop("status")
    b = c.select(
        F.concat(F.lit("B1-"), "feature_a").alias("feature_a"),
        F.concat(F.lit("B2-"), "feature_b").alias("feature_b"),
        (100 - F.col("score")).alias("score"),
    )
    return rc.balanced_queue(c, b)


@query(
    "w6_last_pair_per_parcel",
    with_sql(
        "fx_match",
        """SELECT feature_a, feature_b, score FROM (SELECT *, row_number() OVER (PARTITION BY feature_a
        ORDER BY score, feature_b DESC) AS n FROM fx_match) t WHERE n = 1""",
    ),
)
def w6(spark, sf):
    one = spark.range(1).select(*[F.lit(0).alias(c) for c in ("vertices_snapped", "overlaps_resolved", "gaps_resolved", "slivers_cleaned")])
    return rc.impact(ly.matches(spark, sf), one).select("feature_a", "feature_b", F.col("score_before").alias("score"))


@query(
    "w7_dataset_order",
    with_sql("fx_dataset", "SELECT id, dataset_type FROM fx_dataset ORDER BY id DESC"),
)
def w7(spark, sf):
    return view(spark, sf, "fx_dataset").select("id", "dataset_type").orderBy(F.desc("id"))


@query(
    "r12_topology_impact",
    with_sql(
        "fx_match",
        """, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_a ORDER BY score, feature_b DESC) AS n FROM fx_match) t WHERE n = 1),
        r AS (SELECT m.*, least(99e0, round(score + 4.8e0, 1)) AS score_after FROM m)
        SELECT feature_a, feature_b, score AS score_before, score_after, status AS status_before,
          CASE WHEN score_after >= 75 THEN 'matched' ELSE status END AS status_after FROM r""",
    ),
)
def r12(spark, sf):
    """Effect of correcting the cadastral layer: it snaps over twelve vertices and leaves nothing to the resolvers."""
    parcels = ly.cadastral(spark, sf).select("feature_id", "idx", "geom")
    return rc.impact(ly.matches(spark, sf), correct_topology(parcels)[1]).drop("fixes_applied")


@query("a2_conflicts_by_type", with_sql(CONFLICT_VIEWS, CONFLICTS + "SELECT type, count(*) AS n FROM conflicts GROUP BY type"))
def a2(spark, sf):
    return an.by_type(conflicts(spark, sf))


@query(
    "a3_conflicts_by_severity",
    with_sql(
        CONFLICT_VIEWS,
        CONFLICTS
        + """SELECT s.severity, count(c.severity) AS n FROM (SELECT unnest(['low','medium','high','critical']) AS severity) s
        LEFT JOIN conflicts c ON c.severity = s.severity GROUP BY 1""",
    ),
)
def a3(spark, sf):
    return an.by_severity(conflicts(spark, sf))


@query(
    "a4_resolution",
    with_sql(
        REVIEW_VIEWS,
        CONFLICTS + "," + LATEST + """SELECT count(*) AS total_conflicts, count(*) FILTER (WHERE state = 'APPROVED') AS resolved,
        count(*) FILTER (WHERE state <> 'APPROVED') AS unresolved FROM reviewed""",
    ),
)
def a4(spark, sf):
    return an.resolution(reviewed(spark, sf))


@query(
    "a5_kpi_summary",
    with_sql(
        REVIEW_VIEWS + " fx_dataset",
        CONFLICTS + "," + LATEST + """SELECT (SELECT count(*) FROM fx_dataset) AS total_datasets, (SELECT count(*) FROM fx_match) AS total_matches,
        (SELECT count(*) FROM fx_match WHERE score >= 90) AS high_confidence_matches,
        (SELECT count(*) FROM fx_match WHERE score >= 70 AND score < 90) AS review_band_matches,
        (SELECT count(*) FROM fx_match WHERE score < 70) AS low_agreement_matches,
        (SELECT count(*) FROM reviewed) AS total_conflicts, (SELECT count(*) FROM reviewed WHERE state = 'APPROVED') AS resolved_conflicts,
        (SELECT count(*) FROM reviewed WHERE state <> 'APPROVED') AS unresolved_conflicts,
        (SELECT count(DISTINCT conflict_id) FROM fx_review) AS total_reviews,
        (SELECT count(*) FROM fx_match m JOIN fx_cadastral c ON m.feature_a = c.feature_id WHERE score >= 70) AS total_harmonized_parcels""",
    ),
)
def a5(spark, sf):
    harmonized = harmonize(ly.matches(spark, sf), ly.cadastral(spark, sf))
    return an.kpi_summary(
        view(spark, sf, "fx_dataset"), ly.matches(spark, sf), reviewed(spark, sf), reviews(spark, sf), harmonized
    )


@query(
    "a13_screen_counts",
    with_sql(
        REVIEW_VIEWS,
        CONFLICTS + "," + LATEST + """SELECT count(*) FILTER (WHERE score >= 90) AS matched, count(*) FILTER (WHERE score >= 70 AND score < 90) AS review,
        count(*) FILTER (WHERE state = 'APPROVED') AS resolved, count(*) FILTER (WHERE severity = 'high') AS high_severity,
        count(*) FILTER (WHERE state = 'pending_review') AS pending FROM reviewed""",
    ),
)
def a13(spark, sf):
    return an.screen_counts(reviewed(spark, sf))


def a7(spark, sf):
    groups, members = cc.match_groups(ly.matches(spark, sf))
    return groups.join(members, "group_id")


def _recursive(views: str, body: str) -> str:
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in views.split())
    return f"WITH RECURSIVE {ctes}, {body}"


# Reachability by recursive union; the oracle for the two component operators.
query(
    "a7_match_groups",
    _recursive(
        "fx_match",
        """e AS (SELECT feature_a AS u, feature_b AS v FROM fx_match WHERE score >= 70),
        b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        r(node, seen) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u),
        comp AS (SELECT node, min(seen) AS c FROM r GROUP BY node),
        pairs AS (SELECT c, count(*) AS n FROM e JOIN comp ON e.u = comp.node GROUP BY c),
        sizes AS (SELECT c, CAST(count(*) AS INT) AS member_count FROM comp GROUP BY c)
        SELECT comp.c AS group_id, member_count, pairs.n AS pair_count, CASE WHEN pairs.n >= 2 THEN 'clustered' ELSE 'partial_group' END AS status,
          node AS feature_id FROM comp JOIN pairs ON comp.c = pairs.c JOIN sizes ON comp.c = sizes.c""",
    ),
)(a7)

HAVERSINE = """2*6371.0088e0*asin(least(1e0, sqrt(pow(sin(radians(b.lat-a.lat)/2),2)
  + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))"""
CLUSTERS = f"""e AS (SELECT a.conflict_id AS u, b.conflict_id AS v FROM fx_conflict_point a JOIN fx_conflict_point b
    ON a.lat - 0.006e0 <= b.lat AND b.lat <= a.lat + 0.006e0 AND a.lon - 0.006e0 <= b.lon AND b.lon <= a.lon + 0.006e0
   AND {HAVERSINE} <= 0.5e0),
  r(node, seen) AS (SELECT u, u FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
  comp AS (SELECT node, min(seen) AS c FROM r GROUP BY node)"""


@query("a8_hotspot_clusters", _recursive("fx_conflict_point", CLUSTERS + " SELECT node AS id, c AS first_member FROM comp"))
def a8(spark, sf):
    points = view(spark, sf, "fx_conflict_point").select(F.col("conflict_id").alias("id"), "lat", "lon")
    clusters = cc.proximity_clusters(points)
    first = clusters.groupBy("cluster").agg(F.min("id").alias("first_member"))
    return clusters.join(first, "cluster").select("id", "first_member")


@query(
    "a9_hotspots",
    _recursive(
        "fx_conflict_point",
        CLUSTERS
        + """, j AS (SELECT comp.c, p.*, 'P-' || CAST(conflict_id%40 AS VARCHAR) AS fa, 'M-' || CAST(conflict_id%30 AS VARCHAR) AS fb
            FROM comp JOIN fx_conflict_point p ON p.conflict_id = comp.node),
        named AS (SELECT c, conflict_id*2 AS o, fa AS f FROM j UNION ALL SELECT c, conflict_id*2+1, fb FROM j),
        listed AS (SELECT c, f AS parcel, min(o) AS o FROM named GROUP BY c, f)
        SELECT j.c AS cluster_id, round(avg(lon), 6) AS center_lon, round(avg(lat), 6) AS center_lat, count(*) AS conflict_count,
          CASE WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' ELSE 'low' END AS severity,
          listed.parcel FROM j JOIN listed ON j.c = listed.c GROUP BY j.c, listed.parcel""",
    ),
)
def a9(spark, sf):
    k = F.col("conflict_id")
    rows = view(spark, sf, "fx_conflict_point").withColumns(
        {"feature_a": F.concat(F.lit("P-"), k % 40), "feature_b": F.concat(F.lit("M-"), k % 30)}
    )
    spots, affected = an.hotspots(rows)
    rows = spots.join(affected.select("cluster_id", "parcel"), "cluster_id").drop("affected_count")
    return rows.orderBy(F.desc("conflict_count"), "cluster_id", "parcel")


@query(
    "a10_heat_points",
    with_sql(
        "fx_conflict_point",
        """SELECT concat('HEAT-', CAST(conflict_id AS VARCHAR)) AS heat_id, conflict_id, round(lon, 6) AS lon, round(lat, 6) AS lat, severity,
        CASE severity WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.6e0 ELSE 0.3e0 END AS weight FROM fx_conflict_point""",
    ),
)
def a10(spark, sf):
    return an.heat_points(view(spark, sf, "fx_conflict_point").withColumn("geom", point_geometry("lon", "lat")))

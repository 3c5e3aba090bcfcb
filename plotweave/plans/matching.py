"""Queries on candidate generation and pair scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import deg2_to_m2, map_points, rect, with_stats
from plotweave.functions.text import similarities, similarity
from plotweave.operators import analytics as an
from plotweave.operators import model as md
from plotweave.operators import reconcile as rc
from plotweave.operators import scoring as sc
from plotweave.operators import spatial_join as sj
from plotweave.plans import layers as ly
from plotweave.plans.registry import query
from plotweave.sources.fixtures import corridors, layer, with_sql

PAIR_VIEWS = "fx_cadastral fx_municipal"
NEAR = """, near AS (
  SELECT a.feature_id AS feature_a, b.feature_id AS feature_b,
    a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
    b.area_factor AS f, a.land_use AS lu_a, b.land_use AS lu_b, a.khasra_no AS kh_a, b.khasra_no AS kh_b,
    sqrt(((b.x0+b.x1)/2-(a.x0+a.x1)/2)*((b.x0+b.x1)/2-(a.x0+a.x1)/2)
       + ((b.y0+b.y1)/2-(a.y0+a.y1)/2)*((b.y0+b.y1)/2-(a.y0+a.y1)/2)) AS distance
  FROM fx_cadastral a JOIN fx_municipal b
    ON a.x0-0.0002e0 <= b.x1 AND b.x0 <= a.x1+0.0002e0 AND a.y0-0.0002e0 <= b.y1 AND b.y0 <= a.y1+0.0002e0)"""
INTER = "greatest(0e0, least(ax1,bx1)-greatest(ax0,bx0))*greatest(0e0, least(ay1,by1)-greatest(ay0,by0))"
IOU = f"({INTER}/((ax1-ax0)*(ay1-ay0)+(bx1-bx0)*(by1-by0)-{INTER}))"
AREA_A = "((ax1-ax0)*(ay1-ay0)*cos(radians((ay0+ay1)/2)))"
AREA_B = "((bx1-bx0)*(by1-by0)*cos(radians((by0+by1)/2))*f)"
AREA_SIM = f"(least({AREA_A},{AREA_B})/greatest({AREA_A},{AREA_B}))"


def _corner(p: str, q: str, r: str) -> str:
    """Distance of the four corners of rectangle ``p`` to the outline of rectangle ``r``."""

    def one(x: str, y: str) -> str:
        dx = f"greatest({r}x0-{x}, {x}-{r}x1, 0e0)"
        dy = f"greatest({r}y0-{y}, {y}-{r}y1, 0e0)"
        inside = f"least({x}-{r}x0, {r}x1-{x}, {y}-{r}y0, {r}y1-{y})"
        return f"CASE WHEN {dx}+{dy} > 0 THEN sqrt({dx}*{dx}+{dy}*{dy}) ELSE {inside} END"

    return ", ".join(one(f"{p}x{i}", f"{p}y{j}") for i in "01" for j in "01")


HAUS = f"greatest({_corner('a', '', 'b')}, {_corner('b', '', 'a')})"


def near_rows(spark, sf):
    """Candidate pairs with both prepared features."""
    a, b = sc.prepare(ly.cadastral(spark, sf)), sc.prepare(ly.municipal(spark, sf))
    return sc.pair_rows(sj.candidates(a, b), a, b)


@query("j1_candidates", with_sql(PAIR_VIEWS, NEAR + "SELECT feature_a, feature_b FROM near"))
def j1(spark, sf):
    a, b = with_stats(ly.cadastral(spark, sf)), with_stats(ly.municipal(spark, sf))
    return sj.candidates(a, b).select("feature_a", "feature_b")


@query(
    "j2_fallback",
    with_sql(
        PAIR_VIEWS,
        """, near AS (SELECT DISTINCT a.feature_id FROM fx_cadastral a JOIN fx_municipal b
          ON a.x0+0.5e0-0.0002e0 <= b.x1 AND b.x0 <= a.x1+0.5e0+0.0002e0
         AND a.y0-0.0002e0 <= b.y1 AND b.y0 <= a.y1+0.0002e0),
        first5 AS (SELECT feature_id FROM fx_municipal ORDER BY feature_id LIMIT 5)
        SELECT a.feature_id AS feature_a, b.feature_id AS feature_b
        FROM fx_cadastral a CROSS JOIN first5 b WHERE a.feature_id NOT IN (SELECT feature_id FROM near)""",
    ),
)
def j2(spark, sf):
    """Parcels moved half a degree east: none has a neighbour, all fall back."""
    a = ly.cadastral(spark, sf).withColumn("geom", map_points("geom", lambda x, y: (x + 0.5, y)))
    pairs = sj.candidates(with_stats(a), with_stats(ly.municipal(spark, sf)), fallback=5)
    return pairs.where("fallback").select("feature_a", "feature_b")


@query(
    "j3_capped_candidates",
    with_sql(
        PAIR_VIEWS,
        NEAR
        + """SELECT feature_a, feature_b FROM (SELECT *, row_number() OVER (PARTITION BY feature_a
          ORDER BY round(distance, 9), feature_b) AS n FROM near) t WHERE n <= 10""",
    ),
)
def j3(spark, sf):
    a, b = with_stats(ly.cadastral(spark, sf)), with_stats(ly.municipal(spark, sf))
    return sj.candidates(a, b, cap=10, fallback=0).select("feature_a", "feature_b")


@query(
    "j4_building_pairs",
    with_sql(
        "fx_building",
        """, ranked AS (SELECT dataset_id, row_number() OVER (ORDER BY count(*) DESC, dataset_id) AS r
             FROM fx_building GROUP BY dataset_id)
        SELECT a.feature_id AS feature_a, b.feature_id AS feature_b
        FROM fx_building a JOIN ranked ra ON a.dataset_id = ra.dataset_id AND ra.r = 1
        JOIN fx_building b ON a.x0-0.0002e0 <= b.x1 AND b.x0 <= a.x1+0.0002e0
          AND a.y0-0.0002e0 <= b.y1 AND b.y0 <= a.y1+0.0002e0
        JOIN ranked rb ON b.dataset_id = rb.dataset_id AND rb.r = 2""",
    ),
)
def j4(spark, sf):
    return rc.source_pairs(with_stats(ly.buildings(spark, sf))).select("feature_a", "feature_b")


@query("m1_iou", with_sql(PAIR_VIEWS, NEAR + f"SELECT feature_a, feature_b, round({IOU}, 4) AS iou FROM near"))
def m1(spark, sf):
    rows = near_rows(spark, sf).withColumn("inter", k.intersection_area("a_geom", "b_geom"))
    return rows.select("feature_a", "feature_b", F.round(sc.iou("inter", "a_area_deg2", "b_area_deg2"), 4).alias("iou"))


@query(
    "m2_proximity",
    with_sql(
        PAIR_VIEWS,
        NEAR
        + """SELECT feature_a, feature_b, round(greatest(0e0, least(1e0, 1e0 - distance/0.01e0)), 4) AS proximity
        FROM near""",
    ),
)
def m2(spark, sf):
    return near_rows(spark, sf).select(
        "feature_a", "feature_b", F.round(sc.proximity("a_cx", "a_cy", "b_cx", "b_cy"), 4).alias("proximity")
    )


@query("m3_area_similarity", with_sql(PAIR_VIEWS, NEAR + f"SELECT feature_a, feature_b, round({AREA_SIM}, 4) AS area_sim FROM near"))
def m3(spark, sf):
    return near_rows(spark, sf).select(
        "feature_a", "feature_b", F.round(sc.area_similarity("a_area", "b_area"), 4).alias("area_sim")
    )


@query(
    "m4_hausdorff",
    with_sql(
        PAIR_VIEWS,
        NEAR + f"SELECT feature_a, feature_b, round(greatest(0e0, least(1e0, 1e0 - {HAUS}/0.005e0)), 4) AS haus FROM near",
    ),
)
def m4(spark, sf):
    rows = near_rows(spark, sf).withColumn("h", k.hausdorff("a_geom", "b_geom"))
    return rows.select("feature_a", "feature_b", F.round(sc.hausdorff_similarity("h"), 4).alias("haus"))


def lcs_ratio(a: str, b: str) -> str:
    """Insert/delete similarity of two SQL text expressions, as DuckDB list folds."""
    return f"""(CASE WHEN {a} = {b} THEN 100e0 ELSE 200e0 * list_last((list_reduce(
      list_transform(string_split({a},''), lambda c: {{'ch': c, 'row': []::INT[]}}),
      lambda s, t: {{'ch': t.ch, 'row': list_reduce(
        list_transform(range(1, len({b})+1), lambda j: {{'m': ({b}[j]=t.ch), 'up': s.row[j+1], 'diag': s.row[j], 'out': []::INT[]}}),
        lambda u, v: {{'m': v.m, 'up': v.up, 'diag': v.diag,
          'out': list_append(u.out, greatest(u.out[-1], v.up, CASE WHEN v.m THEN v.diag+1 ELSE 0 END))}},
        {{'m': false, 'up': 0, 'diag': 0, 'out': [0]::INT[]}}).out}},
      {{'ch': '', 'row': list_transform(range(0,len({b})+1), lambda z: 0)::INT[]}})).row) / (len({a})+len({b})) END)"""


@query(
    "t5_similarity",
    f"""WITH t AS (SELECT DISTINCT p_type AS a, p_name AS b FROM part)
    SELECT a, b, round({lcs_ratio('a', 'b')}, 4) AS similarity FROM t""",
)
def t5(spark, sf):
    pairs = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_type").alias("a"), F.col("p_name").alias("b"))
    return pairs.distinct().withColumn("similarity", F.round(similarity("a", "b"), 4))


@query(
    "m5_attribute_similarity",
    with_sql(
        PAIR_VIEWS,
        NEAR
        + f""", words AS (SELECT DISTINCT lower(lu_a) AS a, lower(lu_b) AS b FROM near),
        sims AS (SELECT a, b, {lcs_ratio('a', 'b')}/100 AS s FROM words),
        codes AS (SELECT DISTINCT kh_a AS a, kh_b AS b FROM near WHERE kh_a IS NOT NULL AND kh_b IS NOT NULL),
        csims AS (SELECT a, b, {lcs_ratio('a', 'b')}/100 AS s FROM codes)
        SELECT feature_a, feature_b,
          round(CASE WHEN c.s IS NULL THEN s.s ELSE (s.s + c.s)/2 END, 4) AS attributes,
          concat_ws(',', CASE WHEN c.s >= 0.85e0 THEN 'khasra_no' END, CASE WHEN s.s >= 0.85e0 THEN 'land_use' END) AS matched,
          concat_ws(',', CASE WHEN c.s < 0.85e0 THEN 'khasra_no' END, CASE WHEN s.s < 0.85e0 THEN 'land_use' END) AS differing
        FROM near JOIN sims s ON lower(lu_a) = s.a AND lower(lu_b) = s.b
        LEFT JOIN csims c ON kh_a = c.a AND kh_b = c.b""",
    ),
)
def m5(spark, sf):
    rows = near_rows(spark, sf).withColumn("sims", similarities("a_texts", "b_texts"))
    mean, matched, differing = sc.attribute_evidence("sims")
    return rows.select(
        "feature_a",
        "feature_b",
        F.round(mean, 4).alias("attributes"),
        F.concat_ws(",", matched).alias("matched"),
        F.concat_ws(",", differing).alias("differing"),
    )


@query(
    "m6_reliability",
    """SELECT s_suppkey, round(CASE WHEN s_suppkey%4 = 0 THEN coalesce(greatest(0e0, least(100e0, s_acctbal/50))/100, 0.8e0)
      WHEN s_suppkey%4 = 1 THEN greatest(0e0, least(100e0, 60e0 + (s_nationkey*7)%40))/100 ELSE 0.8e0 END, 6) AS reliability
    FROM supplier""",
)
def m6(spark, sf):
    own = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") / 50)
    source = F.when(F.col("s_suppkey") % 4 == 1, 60.0 + (F.col("s_nationkey") * 7) % 40)
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        "s_suppkey", F.round(sc.reliability(own, source), 6).alias("reliability")
    )


# Evidence drawn from the part table, so that every blend rule is met at any scale.
BLEND_SQL = """WITH e AS (SELECT p_partkey AS k,
    CASE WHEN p_partkey%13=0 THEN 0e0 ELSE (p_partkey%101)/100e0 END AS iou,
    CASE WHEN p_partkey%13=0 THEN 0e0 ELSE (p_partkey*3%101)/100e0 END AS prox,
    CASE WHEN p_partkey%13=0 THEN 0e0 ELSE (p_partkey*7%101)/100e0 END AS area_sim,
    CASE WHEN p_partkey%13=0 THEN 0e0 ELSE (p_partkey*11%101)/100e0 END AS haus,
    CASE WHEN p_partkey%13=0 THEN 0e0 ELSE (p_partkey*17%101)/100e0 END AS attrs,
    (p_partkey*19%101)/100e0 AS rel_a, (p_partkey*23%101)/100e0 AS rel_b,
    CAST(p_partkey*29%101 AS INT) AS mlp_score,
    CASE WHEN p_partkey%17=0 THEN 'ABCDEFGHJK12' ELSE '' END AS a_ulpin_key,
    CASE WHEN p_partkey%34=0 THEN 'ABCDEFGHJK12' ELSE 'SHORT' END AS b_ulpin_key,
    CASE WHEN p_partkey%19=0 THEN '12' ELSE '' END AS a_khasra_key,
    CASE WHEN p_partkey%38=0 THEN '12' ELSE '' END AS b_khasra_key FROM part)"""
HEUR_SQL = """(0.25e0*round(iou,4) + 0.20e0*round(prox,4) + 0.15e0*round(area_sim,4) + 0.15e0*round(haus,4)
    + 0.15e0*round(attrs,4) + 0.10e0*round((rel_a+rel_b)/2,4))*100"""


def _blend_rows(spark, sf):
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(BLEND_SQL + " SELECT * FROM e")


@query("m7_heuristic", BLEND_SQL + f" SELECT k, round({HEUR_SQL}, 6) AS heuristic FROM e")
def m7(spark, sf):
    return sc.components(_blend_rows(spark, sf)).select("k", F.round("heuristic", 6).alias("heuristic"))


@query(
    "m10_blend",
    BLEND_SQL
    + f""", s0 AS (SELECT *, CASE WHEN iou=0 AND prox=0 AND area_sim=0 AND haus=0 AND attrs=0 THEN 0
        ELSE greatest(0, least(100, round_even(0.6e0*mlp_score + 0.4e0*{HEUR_SQL}, 0))) END AS v0 FROM e),
      s1 AS (SELECT *, CASE WHEN a_ulpin_key = b_ulpin_key AND length(a_ulpin_key) >= 11 THEN greatest(v0, 98) ELSE v0 END AS v1 FROM s0),
      s2 AS (SELECT *, CASE WHEN a_khasra_key = b_khasra_key AND a_khasra_key <> '' THEN greatest(v1, 88) ELSE v1 END AS v2 FROM s1)
    SELECT k, CAST(v2 AS INT) AS score,
      CASE WHEN v2 >= 90 THEN 'matched' WHEN v2 >= 70 THEN 'review' ELSE 'unmatched' END AS status FROM s2""",
)
def m10(spark, sf):
    rows = _blend_rows(spark, sf).withColumn("mlp_class", F.lit("review"))
    return sc.blend(sc.components(rows)).select("k", "score", "status")


@query(
    "m11_classify",
    """SELECT p_partkey, CAST(p_partkey%101 AS INT) AS score, CASE WHEN p_partkey%101 >= 85 THEN 'matched'
      WHEN p_partkey%101 >= 60 THEN 'review' ELSE 'unmatched' END AS status FROM part""",
)
def m11(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") % 101).cast("int").alias("score"))
    return parts.withColumn("status", sc.classify("score", 85, 60))


@query(
    "m12_auto_partition",
    with_sql(
        "fx_match",
        """SELECT CASE WHEN score >= 90 THEN 'auto_approved' WHEN score >= 70 THEN 'review_queue' ELSE 'unmatched' END AS queue,
        count(*) AS n, 90 AS threshold_used FROM fx_match GROUP BY 1""",
    ),
)
def m12(spark, sf):
    queues = sc.auto_partition(ly.matches(spark, sf)).groupBy("queue").agg(F.count(F.lit(1)).alias("n"))
    return queues.withColumn("threshold_used", F.lit(90))


SIMS = f""", words AS (SELECT DISTINCT lower(lu_a) AS a, lower(lu_b) AS b FROM near),
        sims AS (SELECT a, b, {lcs_ratio('a', 'b')}/100 AS s FROM words),
        codes AS (SELECT DISTINCT kh_a AS a, kh_b AS b FROM near WHERE kh_a IS NOT NULL AND kh_b IS NOT NULL),
        csims AS (SELECT a, b, {lcs_ratio('a', 'b')}/100 AS s FROM codes)"""


def heuristic_bands(spark, sf):
    """First slice: candidates, all six evidences, weighted, classified, counted."""
    rows = sc.components(sc.evidence(near_rows(spark, sf)))
    return an.band_counts(rows.withColumn("score", F.bround(F.round("heuristic", 9), 0)))


@query(
    "a1_match_bands",
    with_sql(
        PAIR_VIEWS,
        NEAR
        + SIMS
        + f""", s AS (SELECT round_even(round((0.25e0*round({IOU},4) + 0.2e0*round(greatest(0e0, least(1e0, 1e0-distance/0.01e0)),4)
          + 0.15e0*round({AREA_SIM},4) + 0.15e0*round(greatest(0e0, least(1e0, 1e0 - {HAUS}/0.005e0)), 4)
          + 0.15e0*round(CASE WHEN c.s IS NULL THEN s.s ELSE (s.s + c.s)/2 END, 4) + 0.1e0*0.885e0)*100, 9), 0) AS score
          FROM near JOIN sims s ON lower(lu_a) = s.a AND lower(lu_b) = s.b LEFT JOIN csims c ON kh_a = c.a AND kh_b = c.b)
        SELECT count(*) AS total_matches, count(*) FILTER (WHERE score >= 90) AS high_confidence,
          count(*) FILTER (WHERE score >= 70 AND score < 90) AS review_required,
          count(*) FILTER (WHERE score < 70) AS unmatched FROM s""",
    ),
)
def a1(spark, sf):
    return heuristic_bands(spark, sf)


@query(
    "a6_quality_indices",
    with_sql(
        PAIR_VIEWS,
        NEAR
        + f""", words AS (SELECT DISTINCT lower(lu_a) AS a, lower(lu_b) AS b FROM near),
        sims AS (SELECT a, b, {lcs_ratio('a', 'b')}/100 AS s FROM words),
        codes AS (SELECT DISTINCT kh_a AS a, kh_b AS b FROM near WHERE kh_a IS NOT NULL AND kh_b IS NOT NULL),
        csims AS (SELECT a, b, {lcs_ratio('a', 'b')}/100 AS s FROM codes),
        q AS (SELECT round({IOU},4) AS g, round(greatest(0e0, least(1e0, 1e0-distance/0.01e0)),4) AS p, round({AREA_SIM},4) AS r,
          round(CASE WHEN c.s IS NULL THEN s.s ELSE (s.s + c.s)/2 END, 4) AS t
          FROM near JOIN sims s ON lower(lu_a) = s.a AND lower(lu_b) = s.b LEFT JOIN csims c ON kh_a = c.a AND kh_b = c.b)
        SELECT round(avg(g)*100,2) AS geometry_alignment_iou, round(avg(p)*100,2) AS proximity_euclidean,
          round(avg(r)*100,2) AS area_consistency, round(avg(t)*100,2) AS attribute_concordance,
          round((avg(g)+avg(p)+avg(r)+avg(t))*25,2) AS composite_confidence FROM q""",
    ),
)
def a6(spark, sf):
    return an.quality_indices(sc.components(sc.evidence(near_rows(spark, sf))))


def _matched(spark, sf):
    return sc.match(ly.cadastral(spark, sf), ly.municipal(spark, sf), md.default_model(spark))


@query(
    "m8_train_classifier",
    "SELECT p_partkey AS k, CASE WHEN p_partkey%2 = 0 THEN 'matched' ELSE 'unmatched' END AS mlp_class FROM part",
)
def m8(spark, sf):
    """The trained classifier on clear-cut evidence: all of it strong, or all of it weak."""
    k = F.col("p_partkey")
    value = F.when(k % 2 == 0, 0.9 + (k % 10) / 100).otherwise((k % 10) / 100)
    rows = spark.read.parquet(f"{sf}/part.parquet").select(
        k.alias("k"), *[value.alias(n) for n in ("iou", "prox", "area_sim", "haus", "attrs")], F.lit(0.9).alias("rel_a"), F.lit(0.85).alias("rel_b")
    )
    return md.predict_pairs(md.default_model(spark), rows).select("k", "mlp_class")


@query("m9_predict_pairs", with_sql(PAIR_VIEWS, NEAR + "SELECT feature_a, feature_b, true AS sums_to_one, true AS class_is_likeliest, true AS score_follows FROM near"))
def m9(spark, sf):
    """Prediction of every candidate; what must hold whatever the weights."""
    rows = md.predict_pairs(md.default_model(spark), sc.evidence(near_rows(spark, sf)))
    p = {c: F.col(f"mlp_probabilities.{c}") for c in md.CLASSES}
    best = F.greatest(*p.values())
    mean = p["matched"] * 100 + p["review"] * 60
    return rows.select(
        "feature_a",
        "feature_b",
        (F.abs(sum(p.values(), F.lit(0.0)) - 1) < 1e-3).alias("sums_to_one"),
        F.coalesce(*[F.when(F.col("mlp_class") == c, v >= best - 1e-3) for c, v in p.items()]).alias("class_is_likeliest"),
        (F.abs(F.col("mlp_score") - mean) <= 0.52).alias("score_follows"),
    )


@query("m13_match", with_sql(PAIR_VIEWS, NEAR + "SELECT feature_a, feature_b, true AS in_range, true AS status_follows, true AS blended FROM near"))
def m13(spark, sf):
    """The whole run: every candidate once, scores in range, status by score, score near the blend of both opinions or raised by a rule."""
    score = F.col("score")
    heuristic = sc.heuristic({n: F.col(f"c_{n}") for n in sc.WEIGHTS})
    blend = F.greatest(F.lit(0.0), F.least(0.6 * F.col("mlp_score") + 0.4 * heuristic, F.lit(100.0)))
    raised = score.isin(88, 98) & (score >= blend)
    return sc.ranked(_matched(spark, sf)).select(
        "feature_a",
        "feature_b",
        score.between(0, 100).alias("in_range"),
        (F.col("status") == sc.classify(score)).alias("status_follows"),
        ((F.abs(score - blend) <= 0.51) | raised).alias("blended"),
    )


@query(
    "j5_footprint_parcels",
    with_sql(
        "fx_cadastral fx_footprint",
        """SELECT d.feature_id AS footprint_id, c.feature_id AS parcel_id FROM fx_footprint d JOIN fx_cadastral c
        ON d.x0 <= c.x1 AND c.x0 <= d.x1 AND d.y0 <= c.y1 AND c.y0 <= d.y1""",
    ),
)
def j5(spark, sf):
    drone = layer(spark, sf, "fx_footprint").withColumnRenamed("k", "idx")
    return sj.intersecting(drone, ly.cadastral(spark, sf)).select(
        F.col("feature_a").alias("footprint_id"), F.col("feature_b").alias("parcel_id")
    )


@query(
    "j6_corridor_parcels",
    with_sql(
        "fx_corridor fx_cadastral",
        """SELECT corridor_id, feature_id AS parcel_id FROM fx_corridor JOIN fx_cadastral
        ON x0 <= xb + 0.00027e0 AND xa - 0.00027e0 <= x1 AND y0 <= ya + 0.00027e0 AND ya - 0.00027e0 <= y1""",
    ),
)
def j6(spark, sf):
    """Parcels within 0.00027 degrees of a corridor (no parcel starts beyond a corridor's end)."""
    pairs = sj.corridor_pairs(corridors(spark, sf), ly.cadastral(spark, sf), 0.00027)
    pairs = pairs.join(ly.cadastral(spark, sf).select(F.col("feature_id").alias("parcel_id"), "geom"), "parcel_id")
    return pairs.where(k.distance("reach", "geom") <= 0.00027).select("corridor_id", "parcel_id")


OVERLAPS_SQL = f"""SELECT a.k AS idx_a, b.k AS idx_b, a.feature_id AS feature_a, b.feature_id AS feature_b,
  (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))*{ly.FIXED_M2} AS m2
  FROM fx_cadastral a JOIN fx_cadastral b ON a.k < b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"""


@query(
    "j7_overlap_pairs",
    with_sql("fx_cadastral", f", o AS ({OVERLAPS_SQL}) SELECT feature_a, feature_b FROM o WHERE m2 >= 0.01e0"),
)
def j7(spark, sf):
    pairs = sj.overlapping(ly.cadastral(spark, sf))
    return pairs.where(deg2_to_m2("overlap_units") >= 0.01).select("feature_a", "feature_b")


@query(
    "j8_neighbours",
    with_sql(
        "fx_cadastral",
        """, g AS (SELECT a.feature_id AS feature_a, b.feature_id AS feature_b,
          greatest(a.x0-b.x1, b.x0-a.x1, 0e0) AS dx, greatest(a.y0-b.y1, b.y0-a.y1, 0e0) AS dy
          FROM fx_cadastral a JOIN fx_cadastral b ON a.k <> b.k
           AND a.x0-0.00005e0 <= b.x1 AND b.x0 <= a.x1+0.00005e0 AND a.y0-0.00005e0 <= b.y1 AND b.y0 <= a.y1+0.00005e0)
        SELECT feature_a, feature_b FROM g WHERE sqrt(dx*dx+dy*dy) <= 0.00005e0""",
    ),
)
def j8(spark, sf):
    return sj.neighbours(ly.cadastral(spark, sf), 0.00005).select("feature_a", "feature_b")


@query(
    "j14_expected_absence",
    with_sql(
        PAIR_VIEWS,
        """, cov AS (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) - 0.02e0 AS x1, max(y1) AS y1 FROM fx_municipal),
        near AS (SELECT DISTINCT a.feature_id FROM fx_cadastral a JOIN fx_municipal b
          ON a.x0+0.00035e0 <= b.x1 AND b.x0 <= a.x1-0.00035e0 AND a.y0+0.00035e0 <= b.y1 AND b.y0 <= a.y1-0.00035e0)
        SELECT a.feature_id, CASE WHEN (a.x0+a.x1)/2 BETWEEN c.x0 AND c.x1 AND (a.y0+a.y1)/2 BETWEEN c.y0 AND c.y1
          THEN 'real_gap' ELSE 'expected_absence' END AS absence
        FROM fx_cadastral a CROSS JOIN cov c WHERE a.feature_id NOT IN (SELECT feature_id FROM near)""",
    ),
)
def j14(spark, sf):
    """Parcels without partner (boxes shrunk, so holes in the municipal layer show) against its extent."""
    a, b = with_stats(ly.cadastral(spark, sf)), with_stats(ly.municipal(spark, sf))
    near = sj.candidates(a, b, pad=-0.00035)
    extent = b.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), (F.max("maxx") - 0.02).alias("x1"), F.max("maxy").alias("y1"))
    return sj.expected_absence(a, near, extent.select(rect("x0", "y0", "x1", "y1").alias("geom"))).select("feature_id", "absence")

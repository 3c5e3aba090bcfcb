"""Queries on geometry functions, validation, topology, encroachment and parcel edits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plotweave.functions import geometry as gm
from plotweave.functions import kernels as k
from plotweave.functions import projection as pj
from plotweave.operators import encroachment as en
from plotweave.operators import harmonize as hz
from plotweave.operators import topology as tp
from plotweave.operators import validate as vd
from plotweave.operators.corrected import correct_harmonized
from plotweave.operators.reconcile import detect_conflicts
from plotweave.plans import layers as ly
from plotweave.plans.matching import OVERLAPS_SQL
from plotweave.plans.registry import query
from plotweave.session import spread
from plotweave.sources import readers as rd
from plotweave.sources import writers as wr
from plotweave.sources.fixtures import corridors, layer, view, with_sql

C = "fx_cadastral"


@query(
    "g1_reproject",
    with_sql(
        "fx_point_row",
        """SELECT row_id, round(CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lat ELSE lon END, 8) AS lon,
        round(CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lon ELSE lat END, 8) AS lat FROM fx_point_row""",
    ),
)
def g1(spark, sf):
    """Axes put in order, then to the UTM grid and back."""
    rows = view(spark, sf, "fx_point_row").withColumn("geom", gm.point_geometry("lon", "lat"))
    rows = rows.withColumn("geom", gm.fix_inversion("geom"))
    rows = rows.withColumn("geom", gm.map_points("geom", lambda x, y: pj.to_utm(x, y, 32643)))
    rows = rows.withColumn("geom", pj.to_wgs84("geom", "EPSG:32643")).withColumn("c", gm.centroid("geom"))
    return rows.select("row_id", F.round("c.x", 8).alias("lon"), F.round("c.y", 8).alias("lat"))


@query(
    "g2_fix_inversion",
    with_sql(
        "fx_point_row",
        """SELECT row_id, CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lat ELSE lon END AS lon,
        CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lon ELSE lat END AS lat FROM fx_point_row""",
    ),
)
def g2(spark, sf):
    rows = view(spark, sf, "fx_point_row").withColumn("geom", gm.point_geometry("lon", "lat"))
    rows = rows.withColumn("geom", gm.fix_inversion("geom"))
    p = F.col("geom.parts")[0]["shell"][0]
    return rows.select("row_id", p["x"].alias("lon"), p["y"].alias("lat"))


SWAPPED = """, f AS (SELECT row_id, row_id%20 AS file, CASE WHEN row_id%20 < 10 THEN lat + 30 ELSE lat END AS lat, lon FROM fx_point_row),
  s AS (SELECT file, max(abs(lat)) > 90 AND max(abs(lon)) <= 90 AS sw FROM f GROUP BY file)"""


def _files(spark, sf):
    lat = F.when(F.col("row_id") % 20 < 10, F.col("lat") + 30).otherwise(F.col("lat"))
    return view(spark, sf, "fx_point_row").select("row_id", (F.col("row_id") % 20).alias("file"), lat.alias("lat"), "lon")


@query(
    "g3_swap_columns",
    with_sql("fx_point_row", SWAPPED + "SELECT row_id, CASE WHEN sw THEN lon ELSE lat END AS lat, CASE WHEN sw THEN lat ELSE lon END AS lon FROM f JOIN s USING (file)"),
)
def g3(spark, sf):
    return rd.swap_columns(_files(spark, sf), "lat", "lon", "file").select("row_id", "lat", "lon")


@query(
    "s2_points",
    with_sql(
        "fx_point_row",
        """SELECT row_id, CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lat ELSE lon END AS lon,
        CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lon ELSE lat END AS lat FROM fx_point_row WHERE row_id%7 <> 3""",
    ),
)
def s2(spark, sf):
    """Text columns under other names, every seventh latitude unreadable."""
    rows = view(spark, sf, "fx_point_row").select(
        "row_id", F.when(F.col("row_id") % 7 == 3, "n/a").otherwise(F.col("lat").cast("string")).alias(" Y "), F.col("lon").cast("string").alias("LNG")
    )
    p = F.col("geom.parts")[0]["shell"][0]
    return rd.points_from(rows).select("row_id", p["x"].alias("lon"), p["y"].alias("lat"))


@query(
    "g4_coverage",
    with_sql(
        "fx_building",
        """, b AS (SELECT DISTINCT dataset_id, x0, y0, x1, y1 FROM fx_building)
        SELECT dataset_id, round(CAST(sum(CAST(round((x1-x0)*(y1-y0)*1000000, 9) AS DECIMAL(28,9))) AS DOUBLE), 6) AS area FROM b GROUP BY dataset_id""",
    ),
)
def g4(spark, sf):
    """Area of the union: buildings on the same place count once. Sums are decimal, so their order does not matter."""
    parts = rd.coverage(ly.buildings(spark, sf))
    area = F.round(gm.area("geom") * 1000000, 9).cast("decimal(28,9)")
    return parts.groupBy("dataset_id").agg(F.round(F.sum(area).cast("double"), 6).alias("area"))


def _defects(spark, sf):
    """Every tenth parcel a bowtie, every tenth empty."""
    df = view(spark, sf, C)
    p = gm.point
    bow = gm.polygon(F.array(p("x0", "y0"), p("x1", "y1"), p("x1", "y0"), p("x0", "y1"), p("x0", "y0")))
    none = gm.polygon(F.array().cast(gm.RING))
    geom = F.when(F.col("k") % 10 == 1, bow).when(F.col("k") % 10 == 2, none).otherwise(gm.rect("x0", "y0", "x1", "y1"))
    return df.select((F.col("k") % 3).alias("dataset_id"), F.col("k").alias("feature_index"), "feature_id", geom.alias("geom"))


@query(
    "g5_validate",
    with_sql(
        C,
        """SELECT k%3 AS dataset_id, k AS feature_index, CASE k%10 WHEN 1 THEN 'invalid_geometry' ELSE 'empty_geometry' END AS code,
        CASE k%10 WHEN 1 THEN 'Invalid geometry (e.g. self-intersection)' ELSE 'Empty geometry' END AS reason FROM fx_cadastral WHERE k%10 IN (1, 2)""",
    ),
)
def g5(spark, sf):
    return vd.validate(_defects(spark, sf))


@query(
    "a14_validation_report",
    with_sql(
        C,
        """SELECT k%3 AS dataset_id, count(*) AS feature_count, count(*) FILTER (WHERE k%10=2) AS empty_geometry,
        count(*) FILTER (WHERE k%10=1) AS invalid_geometry, count(*) FILTER (WHERE k%10 IN (1,2)) = 0 AS valid,
        CASE WHEN count(*) FILTER (WHERE k%10 IN (1,2)) = 0 THEN 'validated' ELSE 'invalid' END AS status FROM fx_cadastral GROUP BY 1""",
    ),
)
def a14(spark, sf):
    return vd.validation_report(_defects(spark, sf))


@query(
    "g6_repair",
    with_sql(
        C,
        """SELECT k AS feature_index, k%10 = 1 AS repaired, round((x1-x0)*(y1-y0)*CASE WHEN k%10=1 THEN 0.5e0 ELSE 1e0 END*1e9, 3) AS area
        FROM fx_cadastral WHERE k%10 <> 2""",
    ),
)
def g6(spark, sf):
    kept, _ = vd.repair(_defects(spark, sf))
    return kept.select("feature_index", "repaired", F.round(gm.area("geom") * 1e9, 3).alias("area"))


@query(
    "g6_repair_report",
    with_sql(C, """SELECT k%3 AS dataset_id, count(*) FILTER (WHERE k%10<>2) AS feature_count, count(*) FILTER (WHERE k%10=2) AS dropped_count,
        count(*) FILTER (WHERE k%10=1) AS repaired_count FROM fx_cadastral GROUP BY 1"""),
)
def g6_report(spark, sf):
    return vd.repair_report(*vd.repair(_defects(spark, sf)))


def _utm_sql(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing on zone 43N as SQL text."""
    s, d = f"sin(radians({lat}))", f"radians({lon}-75)"
    t = f"sinh(atanh({s}) - {pj._E!r}*atanh({pj._E!r}*{s}))"
    xi, eta = f"atan2({t}, cos({d}))", f"asinh(sin({d})/sqrt({t}*{t}+cos({d})*cos({d})))"
    x = "+".join([eta] + [f"{c!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, c in enumerate(pj.FORWARD, 1)])
    y = "+".join([xi] + [f"{c!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, c in enumerate(pj.FORWARD, 1)])
    return f"({pj._RADIUS!r}*({x}))", f"({pj._RADIUS!r}*({y}))"


def _utm_corners() -> str:
    out = []
    for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))):
        e, n = _utm_sql(x, y)
        out.append(f"{e} AS e{i}, {n} AS n{i}")
    return ", ".join(out)


@query(
    "g7_area_utm",
    with_sql(
        C,
        f""", u AS (SELECT feature_id, {_utm_corners()} FROM fx_cadastral)
        SELECT feature_id, round(abs((e2-e0)*(n3-n1) - (e3-e1)*(n2-n0))/2, 2) AS area FROM u""",
    ),
)
def g7(spark, sf):
    rows = pj.with_area_utm(ly.cadastral(spark, sf))
    return rows.select("feature_id", F.round("area", 2).alias("area"))


@query("g8_area_local", with_sql(C, f"SELECT feature_id, round({ly.RECT_M2}, 2) AS area FROM fx_cadastral"))
def g8(spark, sf):
    return ly.cadastral(spark, sf).select("feature_id", F.round(gm.area_local_m2("geom"), 2).alias("area"))


@query("g9_fixed_latitude", with_sql(C, f"SELECT feature_id, round((x1-x0)*(y1-y0)*{ly.FIXED_M2}, 2) AS m2, round((x1-x0)*(y1-y0)*1e9, 3) AS nano FROM fx_cadastral"))
def g9(spark, sf):
    rows = ly.cadastral(spark, sf).withColumn("m2", gm.deg2_to_m2(gm.area("geom")))
    return rows.select("feature_id", F.round("m2", 2).alias("m2"), F.round(gm.m2_to_deg2("m2") * 1e9, 3).alias("nano"))


@query(
    "g10_area_geodesic",
    with_sql(C, "SELECT feature_id, round((x1-x0)*(y1-y0)*111132.92e0*111412.84e0*cos(radians((3*y0+2*y1)/5)), 1) AS area FROM fx_cadastral"),
)
def g10(spark, sf):
    return ly.cadastral(spark, sf).select("feature_id", gm.area_geodesic("geom").alias("area"))


@query("g11_vertex_count", with_sql(C, "SELECT k AS feature_index, CASE WHEN k%10=2 THEN 0 ELSE 5 END AS n FROM fx_cadastral"))
def g11(spark, sf):
    return _defects(spark, sf).select("feature_index", gm.n_vertices("geom").alias("n"))


@query("g12_centroid", with_sql(C, "SELECT feature_id, round((x0+x1)/2, 9) AS x, round((y0+y1)/2, 9) AS y FROM fx_cadastral"))
def g12(spark, sf):
    rows = ly.cadastral(spark, sf).withColumn("c", gm.centroid("geom"))
    return rows.select("feature_id", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))


@query("g13_vertex_centroid", with_sql(C, "SELECT feature_id, round((3*x0+2*x1)/5, 9) AS x, round((3*y0+2*y1)/5, 9) AS y FROM fx_cadastral"))
def g13(spark, sf):
    rows = ly.cadastral(spark, sf).withColumn("c", gm.vertex_centroid("geom"))
    return rows.select("feature_id", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))


@query("g14_expanded_bbox", with_sql(C, "SELECT feature_id, x0-0.0002e0 AS minx, y0-0.0002e0 AS miny, x1+0.0002e0 AS maxx, y1+0.0002e0 AS maxy FROM fx_cadastral"))
def g14(spark, sf):
    rows = ly.cadastral(spark, sf).withColumn("b", gm.expand_bbox(gm.bbox("geom")))
    return rows.select("feature_id", "b.*")


@query(
    "g16_buffer",
    with_sql("fx_corridor", f"""SELECT corridor_id, round((2*r*(xb-xa) + 64*r*r/2*sin({2 * math.pi / 64!r}))*1e6, 4) AS area
      FROM (SELECT *, 30e0/111000e0 AS r FROM fx_corridor) t"""),
)
def g16(spark, sf):
    grown = en.buffered(corridors(spark, sf), 30.0)
    return grown.select("corridor_id", F.round(gm.area("geom") * 1e6, 4).alias("area"))


@query(
    "g17_box_clip",
    with_sql(C, "SELECT feature_id, round((x1-x0)*0.75e0*(y1-y0)*0.5e0*1e9, 3) AS area FROM fx_cadastral"),
)
def g17(spark, sf):
    """Each parcel against a box covering three quarters of its width and half its height."""
    rows = view(spark, sf, C).withColumn("geom", gm.rect("x0", "y0", "x1", "y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    box = gm.rect(F.col("x0") + w * 0.25, F.col("y0") - h, F.col("x1") + w, F.col("y0") + h * 0.5)
    rows = rows.withColumn("cut", k.clip("geom", box))
    return rows.select("feature_id", F.round(gm.area("cut") * 1e9, 3).alias("area"))


# Encroachment ---------------------------------------------------------------------------

ENC_SQL = """, p AS (SELECT d.k AS dk, c.k AS ck, d.feature_id AS drone, c.feature_id AS parcel,
    12321000000e0*cos(radians((d.y0+d.y1)/2)) AS m, (d.x1-d.x0)*(d.y1-d.y0) AS da,
    greatest(0e0, least(d.x1,c.x1)-greatest(d.x0,c.x0))*greatest(0e0, least(d.y1,c.y1)-greatest(d.y0,c.y0)) AS ia,
    (c.x1-c.x0)*(c.y1-c.y0)*12321000000e0*cos(radians((c.y0+c.y1)/2)) AS cm
  FROM fx_footprint d JOIN fx_cadastral c ON d.x0 <= c.x1 AND c.x0 <= d.x1 AND d.y0 <= c.y1 AND c.y0 <= d.y1),
  e AS (SELECT *, (da-ia)*m AS outm FROM p WHERE (da-ia)*m > 0.01e0),
  enc AS (SELECT concat('ENC-', CAST(dk AS VARCHAR), '-', CAST(ck AS VARCHAR)) AS encroachment_id, parcel AS feature_id_cadastral,
    drone AS feature_id_drone, round(ia*m, 2) AS intersection_area_sqm, round(outm, 2) AS encroachment_area_sqm,
    round(outm/greatest(cm, 1e-6)*100, 2) AS variance_percentage, CASE WHEN outm <= 5 THEN 'permissible' ELSE 'flagged' END AS status,
    CASE WHEN outm > 50 THEN 'critical' WHEN outm > 20 THEN 'high' WHEN outm > 5 THEN 'medium' ELSE 'low' END AS severity FROM e)"""


def _drone(spark, sf):
    return layer(spark, sf, "fx_footprint").withColumnRenamed("k", "idx")


@query("e1_encroachments", with_sql("fx_cadastral fx_footprint", ENC_SQL + "SELECT * FROM enc"))
def e1(spark, sf):
    return en.encroachments(ly.cadastral(spark, sf), _drone(spark, sf))


@query("e2_encroachment_severity", with_sql("fx_cadastral fx_footprint", ENC_SQL + "SELECT status, severity, count(*) AS n FROM enc GROUP BY 1, 2"))
def e2(spark, sf):
    return e1(spark, sf).groupBy("status", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("e3_dataset_report", with_sql("fx_cadastral fx_footprint", ENC_SQL + "SELECT encroachment_id, status, encroachment_area_sqm FROM enc"))
def e3(spark, sf):
    parcels = ly.cadastral(spark, sf).select("idx", "feature_id", "geom", F.lit(1).alias("dataset_id"))
    drone = _drone(spark, sf).select("idx", "feature_id", "geom", F.lit(7).alias("dataset_id"))
    return en.dataset_report(parcels.unionByName(drone), 1, 7).select("encroachment_id", "status", "encroachment_area_sqm")


@query(
    "a11_encroachment_totals",
    with_sql("fx_cadastral fx_footprint", ENC_SQL + """SELECT count(*) FILTER (WHERE status='flagged') AS total_encroachments,
      round(coalesce(sum(encroachment_area_sqm) FILTER (WHERE status='flagged'), 0), 2) AS total_area_sqm FROM enc"""),
)
def a11(spark, sf):
    return en.totals(e1(spark, sf))


@query(
    "e4_row_breaches",
    with_sql(
        "fx_corridor fx_cadastral",
        """, r AS (SELECT *, 30e0/111000e0 AS r FROM fx_corridor),
        j AS (SELECT corridor_id, k, feature_id, x1-x0 AS w, least(y1, ya+r)-greatest(y0, ya-r) AS h,
            (greatest(y0, ya-r)+least(y1, ya+r))/2 AS lat FROM r JOIN fx_cadastral ON y0 < ya+r AND ya-r < y1)
        SELECT concat('ROW-', CAST(corridor_id AS VARCHAR), '-', CAST(k AS VARCHAR)) AS breach_id, feature_id AS parcel_feature,
          round(w*h*12321000000e0*cos(radians(lat)), 2) AS breach_area_sqm FROM j""",
    ),
)
def e4(spark, sf):
    return en.row_breaches(corridors(spark, sf), ly.cadastral(spark, sf), 30.0).select("breach_id", "parcel_feature", "breach_area_sqm")


# Topology -------------------------------------------------------------------------------

GAPS_SQL = """g AS (SELECT k, 0.000003e0*(y1-y0) AS a, (77.2e0 + (k%50+1)*0.001e0 - x1)*(y1-y0)*12321000000e0*cos(radians(28.6e0)) AS m2
  FROM fx_cadastral WHERE k%11=0 AND k%7<>0 AND k%50<49 AND k>=50 AND k + 50 <= (SELECT max(k) FROM fx_cadastral))"""


def _layer(spark, sf):
    return ly.cadastral(spark, sf).select("feature_id", "idx", "geom")


@query(
    "o3_overlaps",
    with_sql(C, f", o AS ({OVERLAPS_SQL}) SELECT feature_a, feature_b, round(m2, 3) AS overlap_area_sqm FROM o WHERE m2 >= 0.01e0"),
)
def o3(spark, sf):
    return tp.detect_overlaps(_layer(spark, sf)).select("feature_a", "feature_b", F.round("overlap_area_sqm", 3).alias("overlap_area_sqm"))


@query("o4_gaps", with_sql(C, f", {GAPS_SQL} SELECT round(m2, 3) AS gap_area_sqm, count(*) AS n FROM g GROUP BY 1"))
def o4(spark, sf):
    found = tp.detect_gaps(_layer(spark, sf))
    return found.groupBy(F.round("gap_area_sqm", 3).alias("gap_area_sqm")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "o5_resolve_overlaps",
    with_sql(
        C,
        f""", o AS ({OVERLAPS_SQL}), lost AS (SELECT idx_b, sum(m2) AS m2 FROM o WHERE m2 > 1e-6 AND m2 <= 100 GROUP BY idx_b)
        SELECT feature_id, round((x1-x0)*(y1-y0)*{ly.FIXED_M2} - coalesce(m2, 0), 3) AS area FROM fx_cadastral LEFT JOIN lost ON k = idx_b""",
    ),
)
def o5(spark, sf):
    done, _ = tp.resolve_overlaps(_layer(spark, sf))
    return done.select("feature_id", F.round(gm.deg2_to_m2(gm.area("geom")), 3).alias("area"))


@query(
    "o5_overlap_chains",
    f"""WITH p AS (SELECT p_partkey AS k, 3 + p_partkey % 8 AS h, 24 + p_partkey % 9 AS r, 1e-10 * {ly.FIXED_M2} AS u FROM part)
    SELECT concat(k, '-', m) AS feature_id, round(u * h * CASE m
      WHEN 0 THEN 10
      WHEN 1 THEN 12 - 2
      WHEN 2 THEN r - 1 - CASE WHEN 9*h*u <= 100 THEN 9 ELSE 0 END - CASE WHEN 10*h*u <= 100 THEN 10 ELSE 0 END
      ELSE 20 - 5 - CASE WHEN (r-20)*h*u <= 100 THEN r-20 ELSE 0 END END, 3) AS area
    FROM p, (SELECT unnest([0, 1, 2, 3]) AS m) x""",
)
def o5_chains(spark, sf):
    """Four parcels in a row that share pieces three at a time: each is clipped by what the earlier ones have kept."""
    p, m, u = F.col("p_partkey"), F.col("m"), 1e-5
    part = spread(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey"), "p_partkey").select("p_partkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("m"))
    x, y = 77 + p % 200 * 1e-3, 28 + F.floor(p / 200) * 1e-3
    first, last = (F.element_at(F.array(*[F.lit(v) for v in ends]), m + 1) for ends in ((0, 8, 1, 15), (10, 20, 0, 35)))
    last = F.when(m == 2, 24 + p % 9).otherwise(last)
    layer = part.select(
        F.concat(p, F.lit("-"), m).alias("feature_id"), (p * 4 + m).alias("idx"),
        gm.rect(x + first * u, y, x + last * u, y + (3 + p % 8) * u).alias("geom"),
    )
    done, _ = tp.resolve_overlaps_in_order(layer)
    return done.select("feature_id", F.round(gm.deg2_to_m2(gm.area("geom")), 3).alias("area"))


@query(
    "o6_resolve_gaps",
    with_sql(
        C,
        f""", {GAPS_SQL} SELECT feature_id, round((x1-x0)*(y1-y0)*{ly.FIXED_M2} + coalesce(m2, 0), 3) AS area
        FROM fx_cadastral c LEFT JOIN g ON c.k = g.k""",
    ),
)
def o6(spark, sf):
    done, _ = tp.resolve_gaps(_layer(spark, sf))
    return done.select("feature_id", F.round(gm.deg2_to_m2(gm.area("geom")), 3).alias("area"))


@query("j9_gap_contacts", with_sql(C, f", {GAPS_SQL} SELECT k AS idx, count(*) AS n FROM g GROUP BY k"))
def j9(spark, sf):
    parcels = _layer(spark, sf)
    return tp.best_contacts(parcels, tp.detect_gaps(parcels)).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


@query("o1_snap_to_reference")
def o1(spark, sf):
    """Municipal parcels snapped to the cadastral layer: changed features."""
    target = ly.municipal(spark, sf).select("feature_id", "idx", "geom")
    return tp.snap(target, _layer(spark, sf))[1].select("feature_id", "vertices_affected", F.round("delta_area_sqm", 2).alias("delta_area_sqm"))


@query("o2_snap_within_layer")
def o2(spark, sf):
    return tp.snap(_layer(spark, sf))[1].select("feature_id", "vertices_affected")


def _spots(spark, sf):
    """A place of its own for every part, hundredths of a degree apart: k, and x, y of its corner."""
    k = F.col("p_partkey")
    return spread(spark.read.parquet(f"{sf}/part.parquet").select(k), "p_partkey").select(
        k.alias("k"), (77 + (k % 100) * 0.01).alias("x"), (28 + F.floor(k / 100) * 0.01).alias("y")
    )


SPOTS_SQL = "s AS (SELECT p_partkey AS k, 77 + (p_partkey%100)*0.01e0 AS x, 28 + (p_partkey//100)*0.01e0 AS y FROM part)"
FIXED_M2 = "12321000000e0*cos(radians(28.6e0))"


def _square(x: str, y: str, right: str = "0.001D", top: str = "0.001D"):
    return gm.rect(F.expr(x), F.expr(y), F.expr(f"x + {right}"), F.expr(f"y + {top}"))


def _strays(spark, sf):
    """(reference squares, strays): a shift within the tolerance, one beyond it, and a wide one whose long sides pass the corners."""
    spots = _spots(spark, sf)
    kind, name = F.col("k") % 3, F.concat(F.lit("P"), F.col("k"))
    geom = (
        F.when(kind == 0, _square("x + 0.00003D", "y - 0.00002D", "0.00103D", "0.00098D"))
        .when(kind == 1, _square("x + 0.0003D", "y + 0.0002D", "0.0013D", "0.0012D"))
        .otherwise(_square("x - 0.0003D", "y + 0.00002D", "0.0013D", "0.00102D"))
    )
    columns = [F.col("k").alias("idx"), name.alias("feature_id")]
    return spots.select(*columns, _square("x", "y").alias("geom")), spots.select(*columns, geom.alias("geom"))


SNAPPED_SQL = f"""WITH {SPOTS_SQL}, b AS (SELECT concat('P', k) AS feature_id, CASE k%3 WHEN 0 THEN x WHEN 1 THEN x + 0.0003e0 ELSE x - 0.0003e0 END AS minx,
    CASE k%3 WHEN 1 THEN y + 0.0002e0 ELSE y END AS miny, CASE k%3 WHEN 0 THEN x + 0.001e0 ELSE x + 0.0013e0 END AS maxx,
    CASE k%3 WHEN 0 THEN y + 0.001e0 WHEN 1 THEN y + 0.0012e0 ELSE y + 0.00102e0 END AS maxy, CASE k%3 WHEN 2 THEN 9 ELSE 5 END AS corners FROM s)"""
BOX_SQL = "round(minx, 9) AS minx, round(miny, 9) AS miny, round(maxx, 9) AS maxx, round(maxy, 9) AS maxy, corners"


def _boxes(df, *names):
    box = [F.round(F.col("b")[n], 9).alias(n) for n in ("minx", "miny", "maxx", "maxy")]
    corners = F.size(F.col("geom.parts")[0]["shell"]).alias("corners")
    return df.withColumn("b", gm.bbox("geom")).select(*names, *box, corners)


@query("o1_snapped_strays", f"{SNAPPED_SQL} SELECT feature_id, {BOX_SQL} FROM b")
def o1_strays(spark, sf):
    """Every stray after snapping: onto the reference corners, unmoved, or with four reference corners let in."""
    squares, strays = _strays(spark, sf)
    return _boxes(tp.snap(strays, squares)[0], "feature_id")


@query("r13_snapped_strays", f"{SNAPPED_SQL} SELECT feature_id, true AS snapped, 'ai_predicted_optimal' AS reconciled_status, {BOX_SQL} FROM b")
def r13_strays(spark, sf):
    squares, strays = _strays(spark, sf)
    return _boxes(tp.snap_buildings(strays, squares), "feature_id", "snapped", "reconciled_status")


def _twins(spark, sf):
    """Two squares at each spot: corners within the tolerance, far apart, or a taller right one beside the left one's side."""
    spots, kind = _spots(spark, sf), F.col("k") % 3
    right = (
        F.when(kind == 0, _square("x + 0.00102D", "y + 0.00001D", "0.002D", "0.00101D"))
        .when(kind == 1, _square("x + 0.0013D", "y", "0.002D"))
        .otherwise(_square("x + 0.00103D", "y - 0.0002D", "0.002D", "0.0012D"))
    )
    side = lambda n, name, geom: spots.select(
        (F.col("k") * 2 + n).alias("idx"), F.concat(F.lit(name), F.col("k")).alias("feature_id"), geom.alias("geom")
    )
    return side(0, "L", _square("x", "y")).union(side(1, "R", right))


@query(
    "o2_snapped_twins",
    f"""WITH {SPOTS_SQL} SELECT concat(CASE k%3 WHEN 0 THEN 'L' ELSE 'R' END, k) AS feature_id, CAST(CASE k%3 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS vertices_affected,
      round(CASE k%3 WHEN 0 THEN 0.00002e0*0.001e0 ELSE 0.00003e0*0.0012e0 END*{FIXED_M2}, 2) AS delta_area_sqm FROM s WHERE k%3 <> 1""",
)
def o2_twins(spark, sf):
    """The left one's corners move to the right one's; a taller right one takes two corners into its side."""
    return tp.snap(_twins(spark, sf))[1].select("feature_id", "vertices_affected", F.round("delta_area_sqm", 2).alias("delta_area_sqm"))


@query(
    "o10_snap_ledger",
    f"""WITH {SPOTS_SQL} SELECT 'snap' AS fix_type, count(*) AS n, CAST(sum(CASE k%3 WHEN 0 THEN 1 ELSE 2 END) AS BIGINT) AS vertices,
      round(sum(round(CASE k%3 WHEN 0 THEN 0.00002e0*0.001e0 ELSE 0.00003e0*0.0012e0 END*{FIXED_M2}, 2)), 1) AS delta FROM s WHERE k%3 <> 1""",
)
def o10_snaps(spark, sf):
    """The whole ledger of a correction run in which everything is snapped, so that nothing is left to merge or fill."""
    fixes = tp.fix_topology(_twins(spark, sf))[1]
    return fixes.groupBy("fix_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("vertices_affected").alias("vertices"), F.round(F.sum(F.round("delta_area_sqm", 2)), 1).alias("delta")
    )


COUNTS_SQL = f""", ov AS ({OVERLAPS_SQL}), {GAPS_SQL},
  c AS (SELECT (SELECT count(*) FROM fx_cadastral) AS n, (SELECT count(*) FROM ov WHERE m2 >= 0.01e0) AS o,
    (SELECT coalesce(sum(m2), 0) FROM ov WHERE m2 >= 0.01e0) AS om, (SELECT count(*) FROM g) AS gp, (SELECT coalesce(sum(m2), 0) FROM g) AS gm)"""
HEALTH = "greatest(0e0, least(100e0, round(100 - least(40e0, o*10 + om/10) - least(30e0, gp*10 + gm/10), 1)))"


@query(
    "a12_topology_counters",
    with_sql(C, COUNTS_SQL + "SELECT n AS features, CAST(0 AS BIGINT) AS invalid, o AS overlaps, round(om, 1) AS overlap_m2, gp AS gaps, round(gm, 1) AS gap_m2 FROM c"),
)
def a12(spark, sf):
    parcels = _layer(spark, sf)
    row = tp.audit(parcels, tp.detect_overlaps(parcels), tp.detect_gaps(parcels))
    return row.withColumns({n: F.round(n, 1) for n in ("overlap_m2", "gap_m2")})


@query(
    "o8_correct_topology",
    with_sql(
        C,
        COUNTS_SQL + f"""SELECT n AS total_features, n AS valid_features, o AS overlaps_detected, gp AS gaps_detected, {HEALTH} AS initial_health_score,
        100e0 AS final_health_score, 'clean' AS status FROM c""",
    ),
)
def o8(spark, sf):
    return tp.correct_topology(_layer(spark, sf))[1].select(
        "total_features", "valid_features", "overlaps_detected", "gaps_detected", "initial_health_score", "final_health_score", "status"
    )


@query("o11_health_audit", with_sql(C, COUNTS_SQL + f"SELECT n AS total_features, {HEALTH} AS initial_health_score, CAST(0 AS BIGINT) AS resolved FROM c"))
def o11(spark, sf):
    row = tp.topology_health(_layer(spark, sf))
    return row.select("total_features", "initial_health_score", (F.col("overlaps_resolved") + F.col("gaps_resolved")).alias("resolved"))


@query(
    "o9_health_score",
    """SELECT p_partkey, greatest(0e0, least(100e0, round(100 - (p_size/100e0)*30 - least(40e0, (p_partkey%5)*10 + p_retailprice/997e0)
      - least(30e0, (p_partkey%3)*10 + p_retailprice/1994e0), 1))) AS health FROM part""",
)
def o9(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    score = tp.health(F.lit(100), "p_size", F.col("p_partkey") % 5, F.col("p_retailprice") / 99.7, F.col("p_partkey") % 3, F.col("p_retailprice") / 199.4)
    return parts.select("p_partkey", score.alias("health"))


@query("o10_fix_ledger", with_sql(C, f""", o AS ({OVERLAPS_SQL}), {GAPS_SQL}
    SELECT 'overlap_merge' AS fix_type, count(*) AS n, round(sum(m2), 1) AS delta FROM o WHERE m2 > 1e-6 AND m2 <= 100
    UNION ALL SELECT 'gap_fill', count(*), round(sum(m2), 1) FROM g"""))
def o10(spark, sf):
    """The ledger of a whole correction run, at a tolerance that leaves overlaps and gaps to the resolvers.

    What is still snapped are vertices that lie on a neighbour's edge already.
    """
    fixes = tp.fix_topology(_layer(spark, sf), tol=1e-9)[1]
    return fixes.where("fix_type <> 'snap'").groupBy("fix_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("delta_area_sqm"), 1).alias("delta"))


@query(
    "o7_make_valid_ledger",
    with_sql(C, "SELECT feature_id, 'Repaired self-intersection / invalid ring via make_valid' AS description FROM fx_cadastral WHERE k%10=1"),
)
def o7(spark, sf):
    return tp.repair_layer(_defects(spark, sf).withColumnRenamed("feature_index", "idx"))[1].select("feature_id", "description")


# Harmonized layer -----------------------------------------------------------------------

HARM_SQL = f""", {ly.FEATURES_SQL}, h AS (SELECT concat('HARM-', feature_a) AS harmonized_id, feature_a AS parcel_id, feature_b, owner, land_use,
    round(area, 2) AS area, CAST(score AS DOUBLE) AS confidence FROM fx_match m JOIN features f ON m.feature_a = f.feature_id WHERE score >= 70)"""
HV = "fx_match fx_cadastral fx_municipal"


def _harmonized(spark, sf):
    return hz.harmonize(ly.matches(spark, sf), ly.cadastral(spark, sf))


@query(
    "r8_harmonize",
    with_sql(
        HV,
        HARM_SQL
        + """SELECT harmonized_id, parcel_id, h.feature_b AS source_feature_b, h.owner, h.land_use, area, confidence, c.name, c.khasra_no
        FROM h JOIN fx_cadastral c ON c.feature_id = h.parcel_id""",
    ),
)
def r8(spark, sf):
    return _harmonized(spark, sf).select(
        "harmonized_id", "parcel_id", "source_feature_b", "owner", "land_use", F.round("area", 2).alias("area"), "confidence",
        "name", "khasra_no",
    )


@query(
    "r8_clashing_ids",
    with_sql(
        "fx_cadastral fx_municipal",
        f""", m AS (SELECT k AS feature_id, 1 AS dataset_id, {ly.RECT_M2} AS area, land_use FROM fx_cadastral
          UNION ALL SELECT k, 2, {ly.RECT_M2} * area_factor, land_use FROM fx_municipal),
        p AS (SELECT a.feature_id, a.area AS area_a, b.area AS area_b, a.land_use FROM m a JOIN m b ON a.feature_id = b.feature_id AND a.dataset_id = 1 AND b.dataset_id = 2)
        SELECT CAST(feature_id AS VARCHAR) AS parcel_id, land_use, round(area_a, 2) AS area, abs(area_a - area_b) > 10 AS conflict FROM p""",
    ),
)
def r8_clash(spark, sf):
    """Both layers name their parcels by bare numbers: dataset and id together find the right feature."""
    features = ly.features(spark, sf).withColumn("feature_id", F.col("idx").cast("string"))
    number = F.col("feature_id")
    pairs = features.where("dataset_id = 1").select(number).join(features.where("dataset_id = 2").select(number), "feature_id")
    pairs = pairs.select(
        number.alias("feature_a"), number.alias("feature_b"), F.lit(1).alias("dataset_a"), F.lit(2).alias("dataset_b"),
        F.lit(95).alias("score"), F.lit("matched").alias("status"),
    )
    found = detect_conflicts(pairs, features).select(F.col("feature_a").alias("parcel_id"), F.lit(True).alias("conflict"))
    rows = hz.harmonize(pairs, features).select("parcel_id", "land_use", F.round("area", 2).alias("area"))
    return rows.join(found, "parcel_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def _merged(spark, sf):
    """Neighbouring pairs of every row; the last parcel of an odd row stays alone and is refused."""
    groups = ly.cadastral(spark, sf).select(
        F.floor(F.col("idx") / 2).alias("group_id"), (F.col("idx") % 2).alias("pos"), "feature_id",
        F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("combined_owner"),
    )
    return hz.merge_parcels(ly.cadastral(spark, sf), groups)


MERGE_SQL = """, m AS (SELECT a.k//2 AS group_id, concat('MERGED-', a.feature_id, '-', b.feature_id) AS parcel_id,
    CASE WHEN a.owner = b.owner THEN a.owner ELSE concat(a.owner, ' & ', b.owner) END AS owner, a.land_use,
    round(((a.x1-a.x0)+(b.x1-b.x0)-greatest(0e0, a.x1-b.x0))*(a.y1-a.y0)*12321000000e0*cos(radians((a.y0+a.y1)/2)), 2) AS area
  FROM fx_cadastral a JOIN fx_cadastral b ON b.k = a.k+1 AND a.k%2=0)"""


@query("r9_merge_parcels", with_sql(C, MERGE_SQL + "SELECT * FROM m"))
def r9(spark, sf):
    return _merged(spark, sf)[0].select("group_id", "parcel_id", "owner", "land_use", "area")


def _split(spark, sf):
    requests = ly.cadastral(spark, sf).select(
        "feature_id", (F.col("idx") % 3 + 2).cast("int").alias("parts"), F.when(F.col("idx") % 2 == 0, "vertical").otherwise("horizontal").alias("direction")
    )
    return hz.split_parcels(ly.cadastral(spark, sf).drop("area"), requests)


@query(
    "r9_merge_errors",
    with_sql(
        C,
        """, n AS (SELECT count(*) AS n FROM fx_cadastral), g AS (SELECT k//2 AS group_id, count(*) AS members FROM fx_cadastral GROUP BY 1)
        SELECT group_id, CASE WHEN members < 2 THEN 'At least 2 parcel IDs are required for a parcel merge.'
          ELSE concat('Parcel with ID ''X-', CAST(group_id*2+1 AS VARCHAR), ''' not found in active registry') END AS error
        FROM g WHERE members < 2 OR group_id%10 = 3""",
    ),
)
def r9_errors(spark, sf):
    """Every tenth group names a parcel that does not exist; a group of one is refused."""
    unknown = (F.floor(F.col("idx") / 2) % 10 == 3) & (F.col("idx") % 2 == 1)
    groups = ly.cadastral(spark, sf).select(
        F.floor(F.col("idx") / 2).alias("group_id"), (F.col("idx") % 2).alias("pos"),
        F.when(unknown, F.concat(F.lit("X-"), "idx")).otherwise(F.col("feature_id")).alias("feature_id"),
        F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("combined_owner"),
    )
    return hz.merge_parcels(ly.cadastral(spark, sf), groups)[1]


@query(
    "r10_split_errors",
    with_sql(
        C,
        """SELECT CASE WHEN k%7=0 THEN concat('X-', feature_id) ELSE feature_id END AS feature_id, CAST(k%13 AS INT) AS parts,
          CASE WHEN k%13 < 2 THEN 'Split must create at least 2 parts.' WHEN k%13 > 10 THEN 'Split must create at most 10 parts.'
            ELSE concat('Parcel with ID ''X-', feature_id, ''' not found in active registry') END AS error
        FROM fx_cadastral WHERE k%13 NOT BETWEEN 2 AND 10 OR k%7=0""",
    ),
)
def r10_errors(spark, sf):
    requests = ly.cadastral(spark, sf).select(
        F.when(F.col("idx") % 7 == 0, F.concat(F.lit("X-"), "feature_id")).otherwise(F.col("feature_id")).alias("feature_id"),
        (F.col("idx") % 13).cast("int").alias("parts"), F.lit("vertical").alias("direction"),
    )
    return hz.split_parcels(ly.cadastral(spark, sf).drop("area"), requests)[1].select("feature_id", "parts", "error")


@query(
    "r10_split_parcels",
    with_sql(
        C,
        """, s AS (SELECT *, k%3+2 AS n, unnest(range(1, CAST(k%3+3 AS BIGINT))) AS i FROM fx_cadastral),
        b AS (SELECT *, CASE WHEN k%2=0 THEN y0 ELSE y0+(i-1)*(y1-y0)/n END AS lo, CASE WHEN k%2=0 THEN y1 ELSE y0+i*(y1-y0)/n END AS hi FROM s)
        SELECT concat(feature_id, '/', CAST(i AS VARCHAR)) AS parcel_id, concat(owner, ' (Subdivision ', CAST(i AS VARCHAR), ')') AS owner,
          round((x1-x0)*(y1-y0)/n*12321000000e0*cos(radians((lo+hi)/2)), 2) AS area FROM b""",
    ),
)
def r10(spark, sf):
    return _split(spark, sf)[0].select("parcel_id", "owner", "area")


def _edits(spark, sf):
    """All merges as edits: every merged parcel supersedes its two members."""
    merged = _merged(spark, sf)[0].drop("group_id")
    return merged, merged.select(F.explode("lineage.sources").alias("parcel_id"))


@query("j13_apply_edits", with_sql(HV, HARM_SQL + MERGE_SQL + "SELECT parcel_id FROM m UNION ALL SELECT parcel_id FROM h WHERE parcel_id NOT IN (SELECT feature_id FROM fx_cadastral WHERE k < 2*((SELECT count(*) FROM fx_cadastral)//2))"))
def j13(spark, sf):
    custom, gone = _edits(spark, sf)
    return hz.apply_edits(_harmonized(spark, sf), gone, custom).select("parcel_id")


@query(
    "r11_find_parcels",
    with_sql(
        C,
        MERGE_SQL + """, w AS (SELECT feature_id AS parcel_id FROM fx_cadastral UNION ALL SELECT parcel_id FROM m UNION ALL SELECT concat('X-', CAST(c_custkey AS VARCHAR)) FROM customer)
        SELECT w.parcel_id, CASE WHEN m.parcel_id IS NOT NULL THEN 'custom' WHEN c.feature_id IS NOT NULL THEN 'features' END AS origin,
          coalesce(m.owner, c.owner) AS owner,
          CASE WHEN m.parcel_id IS NULL AND c.feature_id IS NULL THEN concat('Parcel with ID ''', w.parcel_id, ''' not found in active registry') END AS error
        FROM w LEFT JOIN m ON w.parcel_id = m.parcel_id LEFT JOIN fx_cadastral c ON w.parcel_id = c.feature_id""",
    ),
)
def r11(spark, sf):
    custom, _ = _edits(spark, sf)
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("X-"), "c_custkey").alias("parcel_id"))
    wanted = ly.cadastral(spark, sf).select(F.col("feature_id").alias("parcel_id")).unionByName(custom.select("parcel_id")).unionByName(customers)
    return hz.find_parcels(wanted, custom, ly.cadastral(spark, sf))


@query(
    "r11_trace_parcels",
    """WITH RECURSIVE p AS (SELECT c_custkey AS k FROM customer),
      e AS (SELECT concat('P-', k) AS s, concat('P-', k//2) AS t FROM p WHERE k >= 8 UNION SELECT concat('P-', k), concat('S-', k) FROM p WHERE k%5=0
        UNION SELECT concat('P-', k), concat('P-', 2*k) FROM p WHERE k%50=7),
      c(a, b) AS (SELECT s, t FROM e UNION SELECT a, t FROM c JOIN e ON b = s),
      w AS (SELECT concat('P-', k) AS a FROM p),
      r AS (SELECT a, b FROM c UNION SELECT a, a FROM w),
      g AS (SELECT a, b FROM r WHERE b NOT IN (SELECT s FROM e)),
      x AS (SELECT DISTINCT r.a FROM r JOIN c ON c.a = r.b AND c.b = r.b)
    SELECT w.a AS parcel_id, g.b AS current_id, x.a IS NOT NULL AS cyclic FROM w LEFT JOIN g ON g.a = w.a LEFT JOIN x ON x.a = w.a""",
)
def r11_trace(spark, sf):
    """Merges in pairs over many generations, every fifth parcel split off as well, some merged into what came from them."""
    k = F.col("c_custkey")
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(k)

    def steps(when, to):
        return customers.where(when).select(F.concat(F.lit("P-"), k).alias("source_id"), to.alias("parcel_id"))

    lineage = steps(k >= 8, F.concat(F.lit("P-"), F.floor(k / 2)))
    lineage = lineage.union(steps(k % 5 == 0, F.concat(F.lit("S-"), k))).union(steps(k % 50 == 7, F.concat(F.lit("P-"), 2 * k)))
    return hz.trace_parcels(customers.select(F.concat(F.lit("P-"), k).alias("parcel_id")), lineage)


@query("r13_snap_buildings")
def r13(spark, sf):
    """Buildings of the first survey against the harmonized boundary."""
    b = ly.buildings(spark, sf).withColumn("idx", F.xxhash64("feature_id"))
    boundary = _harmonized(spark, sf).select("geom", F.xxhash64("parcel_id").alias("idx"))
    return tp.snap_buildings(b, boundary).select("dataset_id", "feature_id", "snapped", "reconciled_status")


def _corrected(spark, sf):
    custom, gone = _edits(spark, sf)
    number = F.regexp_extract("parcel_id", r"(\d+)$", 1).cast("long")
    return correct_harmonized(
        _harmonized(spark, sf), ly.matches(spark, sf), ly.buildings(spark, sf), gone, custom, order=number
    )


@query("r14_correct_harmonized")
def r14(spark, sf):
    """The corrected layer, edits included, and the snapped buildings."""
    done = _corrected(spark, sf)
    size = F.round(gm.deg2_to_m2(gm.area("geom")), 2).alias("area")
    parcels = done.layer.select(F.lit("parcel").alias("kind"), F.col("parcel_id").alias("feature_id"), "owner", size)
    buildings = done.buildings.select(F.lit("building").alias("kind"), "feature_id", F.lit(None).cast("string").alias("owner"), size)
    return parcels.unionByName(buildings)


@query(
    "s9_registry_export",
    with_sql(HV, HARM_SQL + """SELECT harmonized_id AS "Harmonized ID", parcel_id AS "Parcel ID", owner AS "Owner", land_use AS "Land Use", '' AS "Zone", '' AS "Address",
      area AS "Area (sqm)", CAST(CAST(confidence AS INT) AS VARCHAR) AS "Confidence (%)", 'certified_reconciled' AS "Status", 'harmonized' AS "Operation", 14 AS code_length FROM h"""),
)
def s9(spark, sf):
    """All eleven columns; the area text is read back as a number, the parcel code shows its length."""
    rows = wr.registry_rows(_harmonized(spark, sf))
    code = F.length("ULPIN / Bhu-Aadhar").alias("code_length")
    return rows.withColumn("Area (sqm)", F.round(F.col("Area (sqm)").cast("double"), 2)).select("*", code).drop("ULPIN / Bhu-Aadhar")


@query(
    "s11_audit_export",
    with_sql(HV, HARM_SQL + """SELECT harmonized_id AS "Harmonized ID", parcel_id AS "Parcel ID", parcel_id AS "Cadastral Source", feature_b AS "Municipal Source", owner AS "Owner",
      land_use AS "Classification", '' AS "Zone", '' AS "Address", area AS "Area (m2)",
      concat(CAST(CAST(confidence AS INT) AS VARCHAR), '%') AS "Confidence", 'certified_reconciled' AS "Status" FROM h"""),
)
def s11(spark, sf):
    rows = _harmonized(spark, sf).withColumns({"cadastral_id": F.col("source_feature_a"), "municipal_id": F.col("source_feature_b")})
    return wr.audit_rows(rows).withColumn("Area (m2)", F.round(F.col("Area (m2)").cast("double"), 2))

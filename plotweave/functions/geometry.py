"""Geometry as plain Spark columns.

A geometry is ``struct<type, parts: array<struct<shell, holes>>>``. Polygons keep
closed rings; points and lines keep their coordinates in ``shell``. Everything in
this module is a JVM-side Column expression, so it stays inside the scan stage.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
GEOMETRY_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "parts",
            T.ArrayType(
                T.StructType([T.StructField("shell", RING_TYPE), T.StructField("holes", T.ArrayType(RING_TYPE))])
            ),
        ),
    ]
)
POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
PART = f"struct<shell:{RING},holes:array<{RING}>>"
GEOMETRY = f"struct<type:string,parts:array<{PART}>>"

# Metres per degree used by the area and distance conversions.
METRES_PER_DEGREE = 111000.0
METRES_PER_DEGREE_SHIFT = 111139.0
METRES_PER_DEGREE_LAT = 111132.92
METRES_PER_DEGREE_LON = 111412.84
REFERENCE_LATITUDE = 28.6

POLYGONAL = ("Polygon", "MultiPolygon")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def part(shell: Column, holes: Column | None = None) -> Column:
    no_holes = F.array().cast(f"array<{RING}>")
    return F.struct(shell.alias("shell"), (no_holes if holes is None else holes).alias("holes"))


def polygon(shell: Column, holes: Column | None = None) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(part(shell, holes)).alias("parts")).cast(GEOMETRY)


def rect(x0, y0, x1, y1) -> Column:
    """Closed counter-clockwise rectangle."""
    return polygon(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def line(*points: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(part(F.array(*points))).alias("parts")).cast(GEOMETRY)


def point_geometry(x, y) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(part(F.array(point(x, y)))).alias("parts")).cast(GEOMETRY)


def map_points(geom, fn) -> Column:
    """Apply ``fn(x, y) -> (x, y)`` to every coordinate."""
    g = col(geom)

    def ring(r: Column) -> Column:
        return F.transform(r, lambda p: F.struct(*[v.alias(n) for v, n in zip(fn(p["x"], p["y"]), "xy")]))

    parts = F.transform(
        g["parts"], lambda q: part(ring(q["shell"]), F.transform(q["holes"], lambda h: ring(h)))
    )
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), parts.alias("parts"))).cast(GEOMETRY)


def swap_xy(geom) -> Column:
    return map_points(geom, lambda x, y: (y, x))


def _sql(template: str, geom) -> Column:
    """A geometry expression over a named column, parsed once by the JVM."""
    if not isinstance(geom, str):
        raise TypeError("name the geometry column; add derived geometry with withColumn first")
    return F.expr(" ".join(template.split()).replace("$g", geom))


def let(value: str, name: str, body: str) -> str:
    """SQL text binding ``value`` once for ``body``; keeps the expression tree linear."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


SHELL_POINTS = "flatten(transform($g.parts, p -> p.shell))"
RINGS = "flatten(transform($g.parts, p -> concat(array(p.shell), p.holes)))"
EMPTY = "($g is null or not coalesce(exists($g.parts, p -> size(p.shell) > 0), false))"
ORIGIN = "get(get($g.parts, 0).shell, 0)"
IS_POLYGON = "$g.type in ('Polygon', 'MultiPolygon')"

# Doubled area and first moments of ring ``r`` around origin ``o``; ``w`` is +1 or -1.
_MOMENTS = """aggregate(r,
  named_struct('px', double(null), 'py', double(null), 'a', 0D, 'mx', 0D, 'my', 0D),
  (s, p) -> named_struct(
    'px', p.x - o.x,
    'py', p.y - o.y,
    'a', s.a + coalesce(s.px * (p.y - o.y) - (p.x - o.x) * s.py, 0D),
    'mx', s.mx + coalesce((s.px + (p.x - o.x)) * (s.px * (p.y - o.y) - (p.x - o.x) * s.py), 0D),
    'my', s.my + coalesce((s.py + (p.y - o.y)) * (s.px * (p.y - o.y) - (p.x - o.x) * s.py), 0D)),
  s -> named_struct('a', w * abs(s.a), 'mx', w * signum(s.a) * s.mx, 'my', w * signum(s.a) * s.my))"""


def _moments(ring: str, side: int) -> str:
    return re.sub(r"\bw\b", f"({side})", re.sub(r"aggregate\(r,", f"aggregate({ring},", _MOMENTS))


_TOTAL_MOMENTS = f"""aggregate(
  flatten(transform($g.parts, q -> concat(array({_moments('q.shell', 1)}),
                                          transform(q.holes, h -> {_moments('h', -1)})))),
  named_struct('a', 0D, 'mx', 0D, 'my', 0D),
  (t, m) -> named_struct('a', t.a + m.a, 'mx', t.mx + m.mx, 'my', t.my + m.my))"""

_RING_AREA2 = """aggregate(r,
  named_struct('px', double(null), 'py', double(null), 'a', 0D),
  (s, p) -> named_struct('px', p.x - o.x, 'py', p.y - o.y,
                         'a', s.a + coalesce(s.px * (p.y - o.y) - (p.x - o.x) * s.py, 0D)),
  s -> abs(s.a))"""


def _ring_area2(ring: str) -> str:
    return _RING_AREA2.replace("aggregate(r,", f"aggregate({ring},")


_AREA2 = f"""aggregate($g.parts, 0D, (t, q) ->
  t + {_ring_area2('q.shell')} - aggregate(q.holes, 0D, (u, h) -> u + {_ring_area2('h')}))"""

_WALK = """aggregate(
  transform($g.parts, q -> aggregate(q.shell,
    named_struct('px', double(null), 'py', double(null), 'w', 0D, 'sx', 0D, 'sy', 0D),
    (s, p) -> named_struct('px', p.x, 'py', p.y,
      'w', s.w + coalesce(hypot(p.x - s.px, p.y - s.py), 0D),
      'sx', s.sx + coalesce(hypot(p.x - s.px, p.y - s.py) * (s.px + p.x) / 2, 0D),
      'sy', s.sy + coalesce(hypot(p.x - s.px, p.y - s.py) * (s.py + p.y) / 2, 0D)))),
  named_struct('w', 0D, 'sx', 0D, 'sy', 0D),
  (t, m) -> named_struct('w', t.w + m.w, 'sx', t.sx + m.sx, 'sy', t.sy + m.sy))"""

_MEAN = """named_struct('x', aggregate(v, 0D, (a, p) -> a + p.x) / size(v),
                        'y', aggregate(v, 0D, (a, p) -> a + p.y) / size(v))"""


def shell_points(geom: str) -> Column:
    """All shell coordinates of all parts, pooled."""
    return _sql(SHELL_POINTS, geom)


def is_empty(geom: str) -> Column:
    return _sql(EMPTY, geom)


_BBOX = let(
    SHELL_POINTS,
    "v",
    """named_struct('minx', array_min(transform(v, p -> p.x)), 'miny', array_min(transform(v, p -> p.y)),
                    'maxx', array_max(transform(v, p -> p.x)), 'maxy', array_max(transform(v, p -> p.y)))""",
)


def bbox(geom: str) -> Column:
    """struct(minx, miny, maxx, maxy); null members when the geometry is empty."""
    return _sql(_BBOX, geom)


def n_vertices(geom: str) -> Column:
    """Coordinate count, the closing vertex of each ring included."""
    return _sql(f"coalesce(aggregate({RINGS}, 0, (a, r) -> a + size(r)), 0)", geom)


_AREA = f"if({IS_POLYGON}, {let(ORIGIN, 'o', _AREA2)} / 2, 0D)"


def area(geom: str) -> Column:
    """Planar area in squared coordinate units."""
    return _sql(_AREA, geom)


def centroid(geom: str) -> Column:
    """Area-weighted for polygons, length-weighted for lines, mean for points."""
    moments = let(
        _TOTAL_MOMENTS,
        "m",
        "if(m.a > 0, named_struct('x', o.x + m.mx / (m.a * 3), 'y', o.y + m.my / (m.a * 3)), null)",
    )
    by_area = let(ORIGIN, "o", moments)
    by_length = let(_WALK, "w", "if(w.w > 0, named_struct('x', w.sx / w.w, 'y', w.sy / w.w), null)")
    return _sql(
        f"""case when {EMPTY} then null else coalesce(
              case when {IS_POLYGON} then {by_area} end,
              case when $g.type not in ('Point', 'MultiPoint') then {by_length} end,
              {let(SHELL_POINTS, 'v', _MEAN)}) end""",
        geom,
    )


def vertex_centroid(geom: str) -> Column:
    """Mean of shell vertices, closing vertex counted; null for lines and empties."""
    mean = let(SHELL_POINTS, "v", _MEAN)
    return _sql(f"if(($g.type = 'Point' or {IS_POLYGON}) and size({SHELL_POINTS}) > 0, {mean}, null)", geom)


def area_local_m2(geom: str) -> Column:
    """Square metres when the box looks geographic and is under ten degrees wide, else planar.

    ``local_m2`` in SQL text that works out area and box once: Spark repeats expressions with lambdas wherever they occur.
    """
    geographic = "b.minx between -180D and 180D and b.miny between -90D and 90D and abs(b.maxx - b.minx) < 10D"
    scaled = f"if({geographic}, a * ({METRES_PER_DEGREE**2!r}D * cos(radians((b.miny + b.maxy) / 2D))), a)"
    return _sql(let(_BBOX, "b", let(_AREA, "a", scaled)), geom)


def local_m2(area_units, minx, miny, maxx, maxy) -> Column:
    a, x0, y0, x1, y1 = (col(c) for c in (area_units, minx, miny, maxx, maxy))
    geographic = x0.between(-180.0, 180.0) & y0.between(-90.0, 90.0) & (F.abs(x1 - x0) < 10.0)
    scale = F.lit(METRES_PER_DEGREE**2) * F.cos(F.radians((y0 + y1) / 2.0))
    return F.when(geographic, a * scale).otherwise(a)


_FIXED_SCALE = METRES_PER_DEGREE * (METRES_PER_DEGREE * math.cos(math.radians(REFERENCE_LATITUDE)))


def deg2_to_m2(area_deg2) -> Column:
    """Square degrees to square metres at the fixed reference latitude."""
    return col(area_deg2) * F.lit(_FIXED_SCALE)


def m2_to_deg2(area_m2) -> Column:
    return col(area_m2) / F.lit(_FIXED_SCALE)


def area_geodesic(geom: str) -> Column:
    """Shoelace on metres per degree at the vertex-mean latitude of the outer ring, 1 decimal."""
    scaled = f"""if(size(v) < 3, 0D, round(
        {let('get(v, 0)', 'o', _ring_area2('v'))} / 2 * {METRES_PER_DEGREE_LAT}D * {METRES_PER_DEGREE_LON}D
        * cos(radians(aggregate(v, 0D, (a, p) -> a + p.y) / size(v))), 1))"""
    return _sql(let("get($g.parts, 0).shell", "v", scaled), geom)


def shift_m(ax, ay, bx, by) -> Column:
    """Metres between two vertex-mean centres, 1 decimal."""
    ax, ay, bx, by = (col(c) for c in (ax, ay, bx, by))
    dy = (by - ay) * METRES_PER_DEGREE_SHIFT
    dx = (bx - ax) * METRES_PER_DEGREE_SHIFT * F.cos((ay + by) / 2.0 * F.lit(math.pi / 180.0))
    return F.round(F.sqrt(dx * dx + dy * dy), 1)


def expand_bbox(box, pad: float = 0.0002) -> Column:
    b = col(box)
    return F.struct(
        (b["minx"] - pad).alias("minx"),
        (b["miny"] - pad).alias("miny"),
        (b["maxx"] + pad).alias("maxx"),
        (b["maxy"] + pad).alias("maxy"),
    )


def fix_inversion(geom: str) -> Column:
    """Swap x and y where the bounds show that latitude and longitude are exchanged.

    Either y lies outside the latitude range while x fits it, or the box lies in the
    mirrored window of the Indian subcontinent (lat 6..38, lon 68..98).
    """
    b = bbox(geom)

    def within(lo: float, hi: float, low: str, high: str) -> Column:
        return b[low].between(lo, hi) & b[high].between(lo, hi)

    out_of_range = ((b["miny"] < -90) | (b["maxy"] > 90)) & within(-90, 90, "minx", "maxx")
    mirrored = within(6.0, 38.0, "minx", "maxx") & within(68.0, 98.0, "miny", "maxy")
    return F.when(F.coalesce(out_of_range | mirrored, F.lit(False)), swap_xy(geom)).otherwise(col(geom))


def with_stats(df, geom: str = "geom"):
    """Add minx, miny, maxx, maxy, area_deg2, cx and cy once, for the joins that follow."""
    df = df.withColumn("_b", bbox(geom)).withColumn("_c", centroid(geom)).withColumn("area_deg2", area(geom))
    return df.select(
        *[c for c in df.columns if c not in ("_b", "_c")],
        *[F.col(f"_b.{n}").alias(n) for n in ("minx", "miny", "maxx", "maxy")],
        F.col("_c.x").alias("cx"),
        F.col("_c.y").alias("cy"),
    )


def _bracketed(body: Column) -> Column:
    return F.concat(F.lit("["), body, F.lit("]"))


def _json_points(ring: Column) -> Column:
    text = F.transform(
        ring,
        lambda p: _bracketed(F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))),
    )
    return F.array_join(text, ",")


def to_geojson(geom) -> Column:
    """Geometry as GeoJSON text."""
    g = col(geom)
    shells = F.transform(g["parts"], lambda p: _json_points(p["shell"]))
    poly = F.transform(
        g["parts"],
        lambda p: _bracketed(
            F.array_join(
                F.transform(F.concat(F.array(p["shell"]), p["holes"]), lambda r: _bracketed(_json_points(r))), ","
            )
        ),
    )
    coords = (
        F.when(g["type"] == "Point", F.get(shells, F.lit(0)))
        .when(g["type"].isin("LineString", "MultiPoint"), _bracketed(F.array_join(shells, ",")))
        .when(g["type"] == "MultiLineString", _bracketed(F.array_join(F.transform(shells, _bracketed), ",")))
        .when(g["type"] == "Polygon", F.coalesce(F.get(poly, F.lit(0)), F.lit("[]")))
        .otherwise(_bracketed(F.array_join(poly, ",")))
    )
    return F.when(
        g.isNotNull(), F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), coords, F.lit("}"))
    )

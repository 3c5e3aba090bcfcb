"""Readers: GeoJSON, delimited points and WKT, KML, node/way extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import GEOMETRY, RING, fix_inversion, is_empty, part, point_geometry, polygon
from plotweave.functions.projection import epsg, to_wgs84
from plotweave.functions.text import numeric_value
from plotweave.operators.union import dissolved_parts
from plotweave.operators.validate import CRS_MISSING, FILE_UNREADABLE
from plotweave.session import cut
from plotweave.sources.collections import read_elements

# Recognized column names, first hit wins.
WKT_COLUMNS = ["geometry", "wkt", "geom", "the_geom", "shape"]
LAT_COLUMNS = ["latitude", "lat", "y", "y_coord", "northing"]
LON_COLUMNS = ["longitude", "lon", "long", "lng", "x", "x_coord", "easting"]

_SHAPE = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
_FEATURE = f"type string, properties map<string,string>, geometry {_SHAPE}"
UNREADABLE_REASON = "Failed to read geospatial file"
_DEPTH = {
    "Point": "array<double>",
    "MultiPoint": "array<array<double>>",
    "LineString": "array<array<double>>",
    "MultiLineString": "array<array<array<double>>>",
    "Polygon": "array<array<array<double>>>",
    "MultiPolygon": "array<array<array<array<double>>>>",
}


def parse_coordinates(kind: str, coordinates: str) -> Column:
    """Geometry from a type column and a column of raw coordinate JSON."""

    def ring(values: str) -> str:
        return f"transform({values}, p -> named_struct('x', get(p, 0), 'y', get(p, 1)))"

    def poly(rings: str) -> str:
        return f"""named_struct('shell', coalesce({ring(f'get({rings}, 0)')}, cast(array() as {RING})),
            'holes', transform(slice({rings}, 2, greatest(size({rings}) - 1, 0)), h -> {ring('h')}))"""

    def bare(points: str) -> str:
        return f"named_struct('shell', {points}, 'holes', cast(array() as array<{RING}>))"

    shapes = {
        "Point": f"array({bare(ring('array(c)'))})",
        "MultiPoint": f"array({bare(ring('c'))})",
        "LineString": f"array({bare(ring('c'))})",
        "MultiLineString": f"transform(c, q -> {bare(ring('q'))})",
        "Polygon": f"array({poly('c')})",
        "MultiPolygon": f"transform(c, q -> {poly('q')})",
    }
    cases = "".join(
        f" when {kind} = '{t}' then get(transform(array(from_json({coordinates}, '{_DEPTH[t]}')), c -> {sql}), 0)"
        for t, sql in shapes.items()
    )
    parts = f"case{cases} end"
    text = f"if({kind} is null, null, named_struct('type', {kind}, 'parts', cast({parts} as array<struct<shell:{RING},holes:array<{RING}>>>)))"
    return F.expr(" ".join(text.split())).cast(GEOMETRY)


def _members(members: Column, single: str) -> tuple[Column, Column]:
    """The geometries of one kind, single or multiple, and their coordinate texts as members of a multi-geometry."""
    own = F.filter(members, lambda m: m["type"].isin(single, f"Multi{single}"))

    def bare(m: Column) -> Column:
        inner = F.substring(m["coordinates"], F.lit(2), F.length(m["coordinates"]) - 2)
        return F.when(m["type"] == single, m["coordinates"]).otherwise(inner)

    return own, F.transform(own, bare)


def _shape_of(rows: DataFrame, geometry: str) -> DataFrame:
    """Columns ``_t`` and ``_c``, type and coordinate text of a GeoJSON geometry.

    A collection becomes the multi-geometry of its polygons, or if it has none of its lines
    or else of its points; that is what the operators can use of it.
    """
    shape = F.col(geometry)
    members = shape["geometries"]
    kind, text = shape["type"], shape["coordinates"]
    collection = kind == "GeometryCollection"
    for single in ("Point", "LineString", "Polygon"):
        own, inner = _members(members, single)
        some = collection & (F.size(own) > 0)
        kind = F.when(some, f"Multi{single}").otherwise(kind)
        text = F.when(some, F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))).otherwise(text)
    return rows.withColumns({"_t": kind, "_c": text})


#: Columns of an uploaded feature, one per line.
UPLOAD = f"dataset_id long, upload_id int, feature_index int, properties map<string,string>, geometry {_SHAPE}"


def uploaded_features(rows: DataFrame) -> DataFrame:
    """``rows`` of UPLOAD, a stream or a table, with ``geom`` in place of the GeoJSON geometry."""
    shaped = _shape_of(rows, "geometry")
    return shaped.withColumn("geom", parse_coordinates("_t", "_c")).drop("geometry", "_t", "_c")


def _collections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, files): parsed features with path and feature_index, and (path, crs, broken) of each file.

    Files are read in byte ranges. A file is broken if its brackets or strings do not close,
    if a feature in it is not readable, or if it has none.
    """
    elements, files = read_elements(spark, path)
    elements = cut(elements)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = elements.where(F.col("kind") == "features").select(
        "path", F.col("index").alias("feature_index"), F.from_json("text", f"{_FEATURE}, _corrupt_record string", options).alias("f")
    )
    systems = elements.where(F.col("kind") == "crs").groupBy("path").agg(
        F.min(F.from_json("text", "type string, properties struct<name:string>")["properties"]["name"]).alias("crs")
    )
    bad = F.col("f").isNull() | F.col("f._corrupt_record").isNotNull()
    read = parsed.groupBy("path").agg(F.count_if(bad).alias("bad"))
    broken = ~F.col("whole") | F.col("bad").isNull() | (F.col("bad") > 0)
    known = files.join(read, "path", "left").join(systems, "path", "left").select("path", "crs", broken.alias("broken"))
    return parsed, cut(known)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections: path, crs, feature_index, properties, geom (as stored). A large file is read by many tasks."""
    parsed, files = _collections(spark, path)
    rows = parsed.join(files.where("NOT broken").select("path", "crs"), "path")
    rows = _shape_of(rows, "f.geometry")
    return rows.select("path", "crs", "feature_index", F.col("f.properties").alias("properties"), parse_coordinates("_t", "_c").alias("geom"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line, the splittable form for large layers: properties, geom."""
    rows = spark.read.schema(_FEATURE).json(path)
    rows = _shape_of(rows, "geometry")
    return rows.select("properties", parse_coordinates("_t", "_c").alias("geom"))


def file_issues(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file problems as issue rows: no CRS member, or not readable as a feature collection."""
    _, files = _collections(spark, path)
    return files.where(F.col("broken") | F.col("crs").isNull()).select(
        "path",
        F.lit(None).cast("int").alias("feature_index"),
        F.when(F.col("broken"), UNREADABLE_REASON).otherwise("CRS missing, cannot normalize").alias("reason"),
        F.when(F.col("broken"), FILE_UNREADABLE).otherwise(CRS_MISSING).alias("code"),
    )


def ingest(layer: DataFrame, crs_names: list[str]) -> DataFrame:
    """Reproject to WGS84 by the layer's ``crs`` column and undo exchanged axes.

    ``crs_names``: the reference systems the layer may contain, known from its catalog.
    """
    geom = F.lit(None).cast(GEOMETRY)
    for name in crs_names:
        epsg(name)
        geom = F.when(F.col("crs") == name, to_wgs84("geom", name)).otherwise(geom)
    return layer.withColumn("geom", geom).withColumn("geom", fix_inversion("geom"))


def _pick(columns: list[str], names: list[str]) -> str | None:
    lower = {c.strip().lower(): c for c in columns}
    return next((lower[n] for n in names if n in lower), None)


def points_from(df: DataFrame, key: str | None = None) -> DataFrame:
    """Point layer from latitude/longitude columns found by name; rows without numbers are dropped.

    Per file (``key``, or the whole frame) the two columns are exchanged when the largest
    latitude is beyond 90 and the largest longitude is not; single rows are checked afterwards.
    """
    lat, lon = _pick(df.columns, LAT_COLUMNS), _pick(df.columns, LON_COLUMNS)
    if lat is None or lon is None:
        raise ValueError("no recognized coordinate columns (latitude/longitude, lat/lon, x/y) or WKT column")
    rows = df.withColumns({"_lat": numeric_value(F.col(lat)), "_lon": numeric_value(F.col(lon))})
    rows = swap_columns(rows, "_lat", "_lon", key)
    rows = rows.where("_lat is not null and _lon is not null").withColumn("geom", point_geometry("_lon", "_lat"))
    return rows.withColumn("geom", fix_inversion("geom")).drop("_lat", "_lon")


def swap_columns(df: DataFrame, lat: str, lon: str, key: str | None = None) -> DataFrame:
    """Exchange two coordinate columns for every file whose latitudes cannot be latitudes."""
    keyed = df.withColumn("_k", F.lit(0) if key is None else F.col(key))
    swap = keyed.groupBy("_k").agg(
        ((F.max(F.abs(lat)) > 90) & (F.max(F.abs(lon)) <= 90)).alias("_swap")
    )
    swap = F.broadcast(swap) if key is None else swap  # one row for the whole frame
    rows = keyed.join(swap, "_k", "left").withColumn("_swap", F.coalesce("_swap", F.lit(False)))
    return rows.withColumns(
        {
            lat: F.when(F.col("_swap"), F.col(lon)).otherwise(F.col(lat)),
            lon: F.when(F.col("_swap"), F.col(lat)).otherwise(F.col(lon)),
        }
    ).drop("_k", "_swap")


def read_points(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited file with coordinate columns; the WKT form is taken when such a column exists."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    if _no_coordinates(df.columns):  # reported by ``table_issues``
        return df.where("false").withColumn("geom", F.lit(None).cast(GEOMETRY))
    return from_wkt(df, _pick(df.columns, WKT_COLUMNS)) if _pick(df.columns, WKT_COLUMNS) else points_from(df)


def from_wkt(df: DataFrame, column: str) -> DataFrame:
    """WKT text column to ``geom``: axes checked, invalid polygons rebuilt, unreadable rows dropped.

    A collection stands for its polygons.
    """
    rows = df.withColumn("_w", F.upper(F.trim(F.col(column))))
    member = r"(?:MULTI)?POLYGON\s*Z?\s*\([^A-DF-Z]*\)"
    inside = F.regexp_extract("_w", r"^GEOMETRYCOLLECTION\s*Z?\s*\((.*)\)$", 1)
    found = F.regexp_extract_all(inside, F.lit(f"({member})"), F.lit(1))
    bodies = F.transform(
        found,
        lambda m: F.when(m.startswith("MULTI"), F.regexp_extract(m, r"\((.*)\)", 1)).otherwise(F.regexp_extract(m, r"(\(.*\))", 1)),
    )
    flat_collection = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(bodies, ", "), F.lit(")"))
    rows = rows.withColumn("_w", F.when(F.size(found) > 0, flat_collection).otherwise(F.col("_w")))
    kind = F.regexp_extract("_w", r"^(MULTIPOLYGON|MULTILINESTRING|MULTIPOINT|POLYGON|LINESTRING|POINT)\s*Z?\s*\(", 1)
    body = F.regexp_extract("_w", r"^[A-Z]+\s*Z?\s*(\(.*\))$", 1)
    # "x y, x y" inside parentheses becomes the bracketed coordinate text of GeoJSON.
    number = r"(-?[0-9.]+(?:E[+-]?[0-9]+)?)"
    pairs = F.regexp_replace(body, rf"{number}\s+{number}(?:\s+{number})?", "[$1,$2]")
    text = F.translate(pairs, "()", "[]")
    rows = rows.withColumns({"_k": kind, "_c": text})
    names = {
        "MULTIPOLYGON": "MultiPolygon", "MULTILINESTRING": "MultiLineString", "MULTIPOINT": "MultiPoint",
        "POLYGON": "Polygon", "LINESTRING": "LineString", "POINT": "Point",
    }
    typed = F.lit(None).cast("string")
    for upper, name in names.items():
        typed = F.when(F.col("_k") == upper, name).otherwise(typed)
    flat = F.when(F.col("_k") == "POINT", F.expr("substring(_c, 2, length(_c) - 2)")).when(
        F.col("_k") == "MULTIPOINT", F.regexp_replace(F.regexp_replace("_c", r"\[\[", "["), r"\]\]", "]"))
    flat = F.when(F.col("_k") == "MULTIPOINT", F.concat(F.lit("["), F.regexp_replace(flat, r"^\[+|\]+$", ""), F.lit("]"))).otherwise(flat)
    flat = F.when(F.col("_k") == "MULTIPOINT", F.concat(F.lit("["), flat, F.lit("]"))).otherwise(flat)
    rows = rows.withColumns({"_c": F.coalesce(flat, F.col("_c")), "_t": typed})
    # Rows without a readable shape vanish in the generator, which also keeps the parsed
    # geometry from being expanded into every expression that follows.
    parsed = rows.withColumn("_g", parse_coordinates("_t", "_c"))
    whole = "transform(array(_g), g -> if(exists(g.parts, p -> size(p.shell) > 0) and not exists(g.parts, p -> exists(p.shell, q -> q.x is null)), g, null))"
    rows = parsed.withColumn("geom", F.explode(F.expr(f"filter({whole}, g -> g is not null)"))).drop("_w", "_k", "_c", "_t", "_g")
    rows = rows.withColumn("geom", F.explode(F.array(fix_inversion("geom")))).withColumn("_ok", k.is_valid("geom"))
    rows = rows.withColumn("_fixed", k.make_valid(F.when(~F.col("_ok"), F.col("geom"))))
    out = rows.withColumn("geom", F.when(F.col("_ok"), F.col("geom")).otherwise(F.col("_fixed"))).drop("_ok", "_fixed")
    return out.where("geom is not null").drop(*([column] if column != "geom" else []))


def _no_coordinates(columns: list[str]) -> bool:
    return not _pick(columns, WKT_COLUMNS) and not (_pick(columns, LAT_COLUMNS) and _pick(columns, LON_COLUMNS))


def table_issues(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """An issue row for each delimited file whose header names neither coordinates nor a WKT column."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value"
    )
    headers = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    files = spark.read.format("binaryFile").load(path).select("path")
    names = F.transform(F.split("header", sep), lambda c: F.lower(F.trim(F.translate(c, '"', ""))))

    def has(words: list[str]) -> Column:
        return F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(w) for w in words])), F.lit(False))

    known = has(WKT_COLUMNS) | (has(LAT_COLUMNS) & has(LON_COLUMNS))
    rows = files.join(headers.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path", "left")
    return rows.where(~known).select(
        "path", F.lit(None).cast("int").alias("feature_index"), F.lit(UNREADABLE_REASON).alias("reason"), F.lit(FILE_UNREADABLE).alias("code")
    )


def kml_issues(spark: SparkSession, path: str) -> DataFrame:
    """An issue row for each KML file without a placemark that has a geometry."""
    files = spark.read.format("binaryFile").load(path).select("path")
    good = read_kml(spark, path).where("geom is not null").select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")).distinct()
    return files.join(good, "path", "left_anti").select(
        "path", F.lit(None).cast("int").alias("feature_index"), F.lit(UNREADABLE_REASON).alias("reason"), F.lit(FILE_UNREADABLE).alias("code")
    )


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """KML placemarks: path, name, description, properties (of ExtendedData), geom.

    A MultiGeometry becomes the multi-geometry of its polygons, or else of its lines or points.
    """
    spots, ring = "struct<coordinates:string>", "struct<LinearRing:struct<coordinates:string>>"
    area = f"struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>"
    schema = f"""name string, description string, Point {spots}, LineString {spots}, Polygon {area},
        MultiGeometry struct<Point:array<{spots}>,LineString:array<{spots}>,Polygon:array<{area}>>,
        ExtendedData struct<Data:array<struct<_name:string,value:string>>,
          SchemaData:struct<SimpleData:array<struct<_VALUE:string,_name:string>>>>"""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)

    def points(text: Column) -> Column:
        words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
        return F.transform(
            words, lambda w: F.struct(F.split(w, ",")[0].cast("double").alias("x"), F.split(w, ",")[1].cast("double").alias("y"))
        )

    def polygon_part(shape: Column) -> Column:
        holes = F.transform(shape["innerBoundaryIs"], lambda b: points(b["LinearRing"]["coordinates"]))
        holes = F.coalesce(holes, F.array().cast(f"array<{RING}>"))
        return part(points(shape["outerBoundaryIs"]["LinearRing"]["coordinates"]), holes)

    def open_part(shape: Column) -> Column:
        return part(points(shape["coordinates"]))

    parts = {"Polygon": polygon_part, "LineString": open_part, "Point": open_part}
    geom = F.lit(None).cast(GEOMETRY)

    def shaped(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), body.alias("parts")).cast(GEOMETRY)

    for kind in reversed(parts):
        several = F.col("MultiGeometry")[kind]
        geom = F.when(F.size(several) > 0, shaped(f"Multi{kind}", F.transform(several, parts[kind]))).otherwise(geom)
    for kind, body in parts.items():
        geom = F.when(F.col(kind).isNotNull(), shaped(kind, F.array(body(F.col(kind))))).otherwise(geom)
    pairs = "array<struct<key:string,value:string>>"
    data = F.transform("ExtendedData.Data", lambda d: F.struct(d["_name"].alias("key"), d["value"].alias("value")))
    simple = F.transform("ExtendedData.SchemaData.SimpleData", lambda d: F.struct(d["_name"].alias("key"), d["_VALUE"].alias("value")))
    both = F.concat(*[F.coalesce(x, F.array().cast(pairs)) for x in (data, simple)])
    first = F.filter(both, lambda p, i: p["key"].isNotNull() & (F.array_position(F.transform(both, lambda q: q["key"]), p["key"]) == i + 1))
    return rows.select(F.col("_metadata.file_path").alias("path"), "name", "description", F.map_from_entries(first).alias("properties"), geom.alias("geom"))


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closed polygons from (way_id, pos, node_id) and (node_id, lon, lat).

    Ways with a missing node are dropped, rings are closed, rings under four points dropped.
    """
    rows = ways.join(nodes, "node_id", "left")
    ring = rows.groupBy("way_id").agg(
        F.bool_and(F.col("lon").isNotNull()).alias("complete"),
        F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("c"),
    )
    ring = ring.where("complete").select("way_id", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("r"))
    closed = F.when(F.col("r")[0] == F.element_at("r", -1), F.col("r")).otherwise(F.concat("r", F.slice("r", 1, 1)))
    ring = ring.select("way_id", closed.alias("r")).where("size(r) >= 4")
    return ring.select("way_id", polygon(F.col("r")).alias("geom"))


def flexible_features(df: DataFrame, column: str) -> DataFrame:
    """Features from GeoJSON text that is a collection, a feature, a bare geometry or a list of any."""
    feature = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>,coordinates:string>"
    text = F.trim(F.col(column))
    item = F.from_json(text, feature)
    listed = F.from_json(text, f"array<{feature}>")
    inside = F.from_json(text, f"features array<{feature}>")["features"]
    items = F.when(text.startswith("["), listed).when(item["type"] == "FeatureCollection", inside).otherwise(F.array(item))
    rows = df.withColumn("_f", F.explode(items))
    f = F.col("_f")
    rows = rows.withColumns(
        {
            "_t": F.when(f["geometry"].isNotNull(), f["geometry"]["type"]).otherwise(f["type"]),
            "_c": F.coalesce(f["geometry"]["coordinates"], f["coordinates"]),
            "properties": F.coalesce(f["properties"], F.create_map().cast("map<string,string>")),
        }
    ).where("_c is not null")
    return rows.withColumn("geom", parse_coordinates("_t", "_c")).drop("_f", "_t", "_c")


def coverage(layer: DataFrame, group: str = "dataset_id") -> DataFrame:
    """Per dataset the union of the convex hulls of its features, one row per polygon of it: (group, geom)."""
    hulls = layer.where(~is_empty("geom")).select(group, k.convex_hull("geom").alias("geom"))
    return dissolved_parts(hulls.where("geom is not null"), group).select(group, "geom")

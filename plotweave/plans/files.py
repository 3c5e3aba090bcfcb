"""Queries that write a layer and read it back, catalog views and streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.geometry import area, to_geojson
from plotweave.plans import layers as ly
from plotweave.plans.registry import query
from plotweave.plans.shapes import HARM_SQL, HV, _defects, _harmonized
from plotweave.session import scratch_folder
from plotweave.sources import readers as rd
from plotweave.sources import writers as wr
from plotweave.sources.fixtures import view, with_sql
from plotweave.streaming import jobs

C = "fx_cadastral"
AREA_SQL = "round((x1-x0)*(y1-y0)*1e9, 3) AS area"


def fresh(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


def _nano(geom: str = "geom"):
    return F.round(area(geom) * 1e9, 3).alias("area")


def _collections(spark, sf) -> str:
    """Feature collections of fifty parcels each, one file per collection."""
    rows = ly.cadastral(spark, sf).select(
        F.floor(F.col("idx") / 50).alias("part"),
        F.concat(
            F.lit('{"type":"Feature","properties":{"feature_id":"'), "feature_id", F.lit('"},"geometry":'), to_geojson("geom"), F.lit("}")
        ).alias("f"),
    )
    docs = rows.groupBy("part").agg(F.array_join(F.collect_list("f"), ",").alias("fs"))
    crs = F.when(F.col("part") % 3 == 0, F.lit("")).otherwise(
        F.lit('"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},')
    )
    text = F.when(F.col("part") % 4 == 1, F.lit('{"type": "FeatureCollection", "features": [ {broken')).otherwise(
        F.concat(F.lit('{"type":"FeatureCollection",'), crs, F.lit('"features":['), "fs", F.lit("]}"))
    )
    path = fresh(spark)
    docs.select("part", text.alias("value")).write.partitionBy("part").text(path)
    return path


PARTS = "p AS (SELECT DISTINCT k//50 AS part FROM fx_cadastral)"


@query("s1_read_geojson", with_sql(C, f"SELECT feature_id, {AREA_SQL} FROM fx_cadastral WHERE (k//50)%4 <> 1"))
def s1(spark, sf):
    rows = rd.read_geojson(spark, _collections(spark, sf))
    return rows.select(F.col("properties")["feature_id"].alias("feature_id"), _nano())


@query(
    "s6_file_issues",
    with_sql(
        C,
        f""", {PARTS} SELECT part, CASE WHEN part%4=1 THEN 'file_unreadable' ELSE 'crs_missing' END AS code,
        CASE WHEN part%4=1 THEN 'Failed to read geospatial file' ELSE 'CRS missing, cannot normalize' END AS reason FROM p WHERE part%4=1 OR part%3=0""",
    ),
)
def s6(spark, sf):
    rows = rd.file_issues(spark, _collections(spark, sf))
    return rows.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "code", "reason")


def _ring_text(inner: str, outer: str):
    def at(p):
        return F.concat(p["x"].cast("string"), F.lit(inner), p["y"].cast("string"))

    return F.array_join(F.transform(F.col("geom.parts")[0]["shell"], at), outer)


@query("s3_read_wkt", with_sql(C, f"SELECT feature_id, {AREA_SQL} FROM fx_cadastral WHERE k%9 <> 4"))
def s3(spark, sf):
    """WKT column in a delimited file, every ninth value unreadable."""
    text = F.when(F.col("idx") % 9 == 4, "POLYGON oops").otherwise(F.concat(F.lit("POLYGON (("), _ring_text(" ", ", "), F.lit("))")))
    path = fresh(spark)
    ly.cadastral(spark, sf).select("feature_id", text.alias("WKT")).write.option("header", True).csv(path)
    return rd.read_points(spark, path).select("feature_id", _nano())


@query("s4_read_kml", with_sql(C, f"SELECT feature_id, {AREA_SQL} FROM fx_cadastral"))
def s4(spark, sf):
    path = fresh(spark)
    mark = F.concat(
        F.lit("<Placemark><name>"), "feature_id", F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"),
        _ring_text(",", " "), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )
    marks = ly.cadastral(spark, sf).select(F.floor(F.col("idx") / 50).alias("part"), mark.alias("m"))
    docs = marks.groupBy("part").agg(F.array_join(F.collect_list("m"), "").alias("ms"))
    root = F.concat(F.lit('<?xml version="1.0"?><kml><Document>'), "ms", F.lit("</Document></kml>"))
    docs.select("part", root.alias("value")).write.partitionBy("part").text(path)
    return rd.read_kml(spark, path).select(F.col("name").alias("feature_id"), _nano())


@query(
    "s5_assemble_ways",
    with_sql(
        "fx_way_node fx_node",
        """, j AS (SELECT w.*, n.lon, n.lat FROM fx_way_node w LEFT JOIN fx_node n ON w.node_id = n.node_id),
        a AS (SELECT way_id, count(*) AS n, count(lon) AS m, arg_min(lon, rn) AS x0, arg_min(lat, rn) AS y0, arg_max(lon, rn) AS x9, arg_max(lat, rn) AS y9
          FROM (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY pos, lon, lat) AS rn FROM j) t GROUP BY way_id),
        c AS (SELECT way_id, n + CASE WHEN x0 = x9 AND y0 = y9 THEN 0 ELSE 1 END AS points FROM a WHERE n = m)
        SELECT way_id, CAST(points AS INT) AS points FROM c WHERE points >= 4""",
    ),
)
def s5(spark, sf):
    nodes = view(spark, sf, "fx_node")
    rings = rd.assemble_ways(view(spark, sf, "fx_way_node"), nodes)
    return rings.select("way_id", F.size(F.col("geom.parts")[0]["shell"]).alias("points"))


@query(
    "s7_catalog",
    with_sql(
        "fx_dataset fx_source",
        """SELECT d.id, d.dataset_type, s.name AS source_name, regexp_extract(d.file_path, '([^/]+)$', 1) AS filename
        FROM fx_dataset d LEFT JOIN fx_source s ON d.source_id = s.source_id""",
    ),
)
def s7(spark, sf):
    rows = wr.catalog(view(spark, sf, "fx_dataset"), view(spark, sf, "fx_source"))
    return rows.select("id", "dataset_type", "source_name", "filename")


@query(
    "s8_write_geojson",
    with_sql(C, f"SELECT feature_id, 'override' AS owner, {AREA_SQL}, k AS idx, k%2=0 AS even, concat('line', chr(10), '\"', CAST(k AS VARCHAR)) AS note FROM fx_cadastral"),
)
def s8(spark, sf):
    """Written as GeoJSON lines and read back; the attribute wins over the column of the same name.

    Numbers and booleans are parsed as such, which quoted ones would not survive.
    """
    path = fresh(spark)
    attributes = F.create_map(F.lit("owner"), F.lit("override"))
    note = F.concat(F.lit('line\n"'), F.col("idx").cast("string"))
    rows = ly.cadastral(spark, sf).withColumns({"attributes": attributes, "even": F.col("idx") % 2 == 0, "note": note})
    wr.write_geojson(rows, path)
    typed = spark.read.schema("id string, properties struct<feature_id:string,owner:string,idx:bigint,even:boolean,note:string>").json(path)
    shapes = rd.read_geojson_lines(spark, path).select(F.col("properties")["feature_id"].alias("feature_id"), _nano())
    return typed.select("properties.*").join(shapes, "feature_id")


@query("s10_registry_geojson", with_sql(HV, HARM_SQL + "SELECT harmonized_id, parcel_id FROM h"))
def s10(spark, sf):
    path = fresh(spark)
    wr.export_registry(_harmonized(spark, sf).drop("lineage"), path, "geojson")
    props = F.col("properties")
    return rd.read_geojson_lines(spark, path).select(props["feature_id"].alias("harmonized_id"), props["parcel_id"].alias("parcel_id"))


@query("s12_write_layer", with_sql("fx_building", "SELECT dataset_id, feature_id FROM fx_building"))
def s12(spark, sf):
    """Written twice; the second run replaces the first."""
    path = fresh(spark)
    for _ in range(2):
        wr.write_layer(ly.buildings(spark, sf), path)
    return spark.read.parquet(path).select("dataset_id", "feature_id")


@query(
    "s13_replace_dataset",
    with_sql("fx_building", "SELECT dataset_id, feature_id, dataset_id = 2 AS renewed FROM fx_building"),
)
def s13(spark, sf):
    stored = ly.buildings(spark, sf).select("dataset_id", "feature_id", F.lit(False).alias("renewed"))
    return wr.replace_dataset(stored, stored.where("dataset_id = 2").withColumn("renewed", F.lit(True)))


@query(
    "x1_stream_ingest",
    with_sql(C, "SELECT k%4 AS dataset_id, CASE WHEN k%4=1 THEN 2 ELSE 1 END AS upload_id, feature_id FROM fx_cadastral WHERE k%4 <> 1 OR k%8 = 1"),
)
def x1(spark, sf):
    """Two hundred files of four datasets over several micro-batches, then a newer upload of one, and a run without news."""
    inbox, store, state = fresh(spark), fresh(spark), fresh(spark)
    rows = ly.cadastral(spark, sf).select((F.col("idx") % 4).alias("dataset_id"), F.lit(1).alias("upload_id"), "feature_id", "idx")
    newer = rows.where("idx % 8 = 1").withColumn("upload_id", F.lit(2))
    for part, files in ((rows, 200), (newer, 100)):
        part.drop("idx").repartition(files).write.mode("append").json(inbox)
        for _ in range(2):
            uploads = jobs.stream_uploads(spark, inbox, "dataset_id long, upload_id int, feature_id string")
            jobs.run_ingest(uploads, store, state).awaitTermination()
    return jobs.ingested(spark, store)


def _validated_store(spark, sf) -> str:
    """Uploads of three datasets with defects, in many files; dataset 1 comes again without some of its parcels."""
    inbox, store, state = fresh(spark), fresh(spark), fresh(spark)
    rows = _defects(spark, sf).select("dataset_id", F.lit(1).alias("upload_id"), "feature_index", to_geojson("geom").alias("g"))
    again = rows.where("dataset_id = 1 AND feature_index % 2 = 1").withColumn("upload_id", F.lit(2))
    for part, files in ((rows, 60), (again, 40)):
        line = F.concat(
            F.lit('{"dataset_id":'), "dataset_id", F.lit(',"upload_id":'), "upload_id", F.lit(',"feature_index":'), "feature_index",
            F.lit(',"properties":{},"geometry":'), F.coalesce("g", F.lit("null")), F.lit("}"),
        )
        part.select(line.alias("value")).repartition(files).write.mode("append").text(inbox)
        features = rd.uploaded_features(jobs.stream_uploads(spark, inbox, rd.UPLOAD, 25))
        jobs.run_validated_ingest(features, store, state).awaitTermination()
        jobs.compact(spark, store, jobs.newest_uploads)
    return store


UPLOADED = "fx_cadastral WHERE (k%3 <> 1 OR k%2 = 1)"


@query(
    "x1_stream_validation",
    with_sql(
        C,
        f"""SELECT k%3 AS dataset_id, k AS feature_index, CASE k%10 WHEN 1 THEN 'invalid_geometry' ELSE 'empty_geometry' END AS code,
        CASE k%10 WHEN 1 THEN 'Invalid geometry (e.g. self-intersection)' ELSE 'Empty geometry' END AS reason FROM {UPLOADED} AND k%10 IN (1, 2)""",
    ),
)
def x1_validation(spark, sf):
    return jobs.upload_issues(spark, _validated_store(spark, sf))


@query(
    "x1_upload_report",
    with_sql(
        C,
        f"""SELECT k%3 AS dataset_id, CASE WHEN k%3=1 THEN 2 ELSE 1 END AS upload_id, count(*) AS feature_count, count(*) FILTER (WHERE k%10=2) AS empty_geometry,
        count(*) FILTER (WHERE k%10=1) AS invalid_geometry, k%3 <> 2 AS complete,
        CASE WHEN k%3 = 2 THEN 'uploaded' WHEN count(*) FILTER (WHERE k%10 IN (1,2)) = 0 THEN 'validated' ELSE 'invalid' END AS status FROM {UPLOADED} GROUP BY k%3""",
    ),
)
def x1_report(spark, sf):
    """Of dataset 2 one feature more is expected than has come."""
    rows = _defects(spark, sf).where("dataset_id <> 1 OR feature_index % 2 = 1").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    upload = F.when(F.col("dataset_id") == 1, 2).otherwise(1).alias("upload_id")
    expected = rows.select("dataset_id", upload, F.when(F.col("dataset_id") == 2, F.col("n") + 1).otherwise(F.col("n")).alias("expected"))
    return jobs.upload_report(spark, _validated_store(spark, sf), expected)


@query(
    "x2_compacted_reviews",
    with_sql(
        "fx_review",
        """SELECT conflict_id, event_id, CASE WHEN upper(decision) IN ('APPROVED','ACCEPT') THEN 'APPROVED'
        WHEN upper(decision) IN ('REJECTED','REJECT') THEN 'REJECTED' WHEN upper(decision) IN ('FLAGGED','FLAG','EDIT') THEN 'FLAGGED' ELSE upper(decision) END AS decision
        FROM (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_review) t WHERE n = 1""",
    ),
)
def x2_compacted(spark, sf):
    """As the review stream, with a compaction after each of three arrivals, the last one read from generation and tail."""
    inbox, store, state = fresh(spark), fresh(spark), fresh(spark)
    table = view(spark, sf, "fx_review")
    for part in range(3):
        table.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).repartition(4).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 3).parquet(inbox)
        jobs.run_reviews(stream, store, state).awaitTermination()
        if part < 2:
            jobs.compact(spark, store, jobs.review_state)
    return jobs.stored_reviews(spark, store)


@query(
    "x2_stream_reviews",
    with_sql(
        "fx_review",
        """SELECT conflict_id, event_id, CASE WHEN upper(decision) IN ('APPROVED','ACCEPT') THEN 'APPROVED'
        WHEN upper(decision) IN ('REJECTED','REJECT') THEN 'REJECTED' WHEN upper(decision) IN ('FLAGGED','FLAG','EDIT') THEN 'FLAGGED' ELSE upper(decision) END AS decision
        FROM (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_review) t WHERE n = 1""",
    ),
)
def x2(spark, sf):
    """Reviews arrive in several files and batches; the state is a table in shared storage."""
    inbox, store, state = fresh(spark), fresh(spark), fresh(spark)
    table = view(spark, sf, "fx_review")
    table.repartition(8).write.parquet(inbox)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 3).parquet(inbox)
    jobs.run_reviews(stream, store, state).awaitTermination()
    return jobs.stored_reviews(spark, store)

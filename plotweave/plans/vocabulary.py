"""Queries on text, field names, area units and parcel identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import standards as st
from plotweave.functions import text as tx
from plotweave.functions import ulpin as ul
from plotweave.functions.geometry import fix_inversion, point_geometry
from plotweave.operators import standardize as sd
from plotweave.plans.matching import lcs_ratio
from plotweave.plans.registry import query
from plotweave.sources import readers as rd
from plotweave.sources.fixtures import view, with_sql
from plotweave.sources.writers import nan_to_null

FOLD_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _parts(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet")


@query("t1_normalize_text", "SELECT p_partkey, " + FOLD_SQL.format("concat('  ', p_name, ' -/ ', p_brand, '(', p_type, ') ')") + " AS norm FROM part")
def t1(spark, sf):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" -/ "), "p_brand", F.lit("("), "p_type", F.lit(") "))
    return _parts(spark, sf).select("p_partkey", tx.normalize_text(raw).alias("norm"))


@query("t2_normalize_identifier", "SELECT p_partkey, regexp_replace(lower(concat(p_brand, '-', p_name)), '[^a-z0-9]', '', 'g') AS ident FROM part")
def t2(spark, sf):
    return _parts(spark, sf).select("p_partkey", tx.normalize_identifier(F.concat_ws("-", "p_brand", "p_name")).alias("ident"))


@query(
    "t3_numeric_value",
    """SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN p_retailprice WHEN 1 THEN CAST(p_size AS DOUBLE) ELSE NULL END AS num FROM part""",
)
def t3(spark, sf):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_retailprice").cast("string")).when(k == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).when(k == 2, F.col("p_name"))
    return _parts(spark, sf).select("p_partkey", tx.numeric_value(raw).alias("num"))


@query("t4_normalize_key", r"SELECT DISTINCT trim(regexp_replace(lower(trim(concat(' ', p_type, '_', p_brand, '-.', p_name))), '[_\-.\s/]+', ' ', 'g')) AS k FROM part")
def t4(spark, sf):
    raw = F.concat(F.lit(" "), "p_type", F.lit("_"), "p_brand", F.lit("-."), "p_name")
    return _parts(spark, sf).select(tx.normalize_key(raw).alias("k")).distinct()


STEMS = ["Khasra", "MALIK", "mauza", "Rakba-", "gata", "zilla", "remark", "Kism"]
KEY_SQL = f"concat(list_extract({STEMS!r}, CAST(p_partkey%8+1 AS INT)), CASE WHEN p_size%3=0 THEN '_no' WHEN p_size%3=1 THEN ' nam' ELSE '' END)"


def _keyed(spark, sf):
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    tail = F.when(F.col("p_size") % 3 == 0, "_no").when(F.col("p_size") % 3 == 1, " nam").otherwise("")
    props = F.map_from_arrays(F.array(F.concat(stem, tail), F.lit("Owner_Name")), F.array("p_name", "p_brand"))
    return _parts(spark, sf).select(F.col("p_partkey").alias("feature_index"), props.alias("properties"))


def _synonyms(names: dict) -> str:
    seen: dict[str, str] = {}
    for canonical, words in names.items():
        for w in words:
            seen[tx._fold_key(w)] = canonical
    rows = ", ".join(f"('{w}', '{c}', {i})" for i, (w, c) in enumerate(seen.items()))
    return f"(VALUES {rows})"


@query(
    "t6_field_mapping",
    rf"""WITH raw AS (SELECT p_partkey AS k, {KEY_SQL} AS key FROM part UNION ALL SELECT p_partkey, 'Owner_Name' FROM part),
    keys AS (SELECT DISTINCT key, trim(regexp_replace(lower(trim(key)), '[_\-.\s/]+', ' ', 'g')) AS f FROM raw),
    scored AS (SELECT key, canonical, pos, {lcs_ratio('f', 'word')} AS s FROM keys CROSS JOIN {_synonyms(st.FIELD_NAMES)} v(word, canonical, pos)),
    best AS (SELECT key, canonical, s, row_number() OVER (PARTITION BY key ORDER BY s DESC, pos) AS n FROM scored)
    SELECT k, raw.key AS key, CASE WHEN s >= 75 THEN canonical END AS canonical, round(s, 3) AS score
    FROM raw JOIN best ON raw.key = best.key AND n = 1""",
)
def t6(spark, sf):
    rows = sd.map_fields(_keyed(spark, sf))
    both = F.arrays_zip(F.map_keys("properties").alias("key"), "matches")
    return rows.select(F.col("feature_index").alias("k"), F.explode(both).alias("m")).select(
        "k", F.col("m.key").alias("key"), F.col("m.matches.canonical").alias("canonical"), F.round("m.matches.score", 3).alias("score")
    )


def _standardized(spark, sf):
    centre = point_geometry(77 + (F.col("feature_index") % 100) * 0.001, 28 + (F.col("feature_index") % 77) * 0.001)
    return sd.standardize(_keyed(spark, sf).withColumns({"dataset_id": F.lit(1), "geom": centre}), "cadastral")


@query("t7_standardize")
def t7(spark, sf):
    return _standardized(spark, sf)[0].select(
        "feature_index", "feature_id", F.to_json("attributes").alias("attributes"), F.round("area", 2).alias("area")
    )


@query(
    "t7_known_fields",
    """SELECT p_partkey AS feature_index, CASE p_partkey%3 WHEN 0 THEN concat('P', p_partkey) WHEN 1 THEN concat('K', p_partkey) ELSE concat('unknown-', p_partkey) END AS feature_id,
      p_brand AS owner, CASE WHEN p_partkey%3 < 2 THEN p_type END AS land_use, CASE WHEN p_partkey%3 = 2 THEN p_name END AS village,
      CAST(4 AS INT) AS n_attributes, true AS coded FROM part""",
)
def t7_known(spark, sf):
    """Plain, vernacular and missing parcel numbers: owner, land use and village arrive, codes are assigned anew, junk goes."""
    k = F.col("p_partkey")
    named = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs]))
    owner, use = F.col("p_brand"), F.col("p_type")
    props = (
        F.when(k % 3 == 0, named(("plot_no", F.concat(F.lit("P"), k)), ("Owner_Name", owner), ("land_use", use), ("Qxzwv", F.lit("junk"))))
        .when(k % 3 == 1, named(("khasra", F.concat(F.lit("K"), k)), ("malik", owner), ("kism", use)))
        .otherwise(named(("mauza", F.col("p_name")), ("owner", owner), ("ulpin", F.lit("given"))))
    )
    place = point_geometry(77 + (k % 100) * 0.001, 28 + (k % 77) * 0.001)
    rows = _parts(spark, sf).select(F.lit(1).alias("dataset_id"), k.alias("feature_index"), props.alias("properties"), place.alias("geom"))
    got = lambda n: F.try_element_at("attributes", F.lit(n))
    return sd.standardize(rows, "cadastral")[0].select(
        "feature_index", "feature_id", *[got(n).alias(n) for n in ("owner", "land_use", "village")],
        F.size("attributes").alias("n_attributes"), (F.length(got("ulpin")) == 14).alias("coded"),
    )


def _layer_words(layer_type: str) -> str:
    rows = ", ".join(f"('{w.lower()}')" for words in st.LAYER_FIELDS[layer_type].values() for w in words)
    return f"(VALUES {rows})"


@query(
    "t7_unmapped_report",
    rf"""WITH raw AS (SELECT p_partkey AS k, {KEY_SQL} AS key FROM part UNION ALL SELECT p_partkey, 'Owner_Name' FROM part),
    keys AS (SELECT DISTINCT key, lower(key) AS f FROM raw),
    scored AS (SELECT key, max({lcs_ratio('f', 'word')}) AS s FROM keys CROSS JOIN {_layer_words('cadastral')} v(word) GROUP BY key)
    SELECT k AS feature_index, string_agg(raw.key, ',' ORDER BY raw.key = 'Owner_Name') AS unmapped_fields FROM raw JOIN scored ON raw.key = scored.key
    WHERE s < 70 AND lower(raw.key) NOT IN ('ulpin', 'bhu_aadhar', 'parcel_id', 'plot_no', 'khasra', 'खसरा') GROUP BY k""",
)
def t7_unmapped(spark, sf):
    return _standardized(spark, sf)[1].select("feature_index", F.concat_ws(",", "unmapped_fields").alias("unmapped_fields"))


AREA_SQL = """, q AS (SELECT *, CAST(regexp_extract(raw_area, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS n FROM fx_area_text),
  parsed AS (SELECT l_orderkey, l_linenumber,
    CASE l_linenumber%8 WHEN 0 THEN round(n*2529.289e0 + n*126.464e0, 2) WHEN 1 THEN round(n*2529.289e0, 2) WHEN 2 THEN round(n*126.464e0, 2)
      WHEN 3 THEN round(n*101.171e0, 2) WHEN 4 THEN round(n*505.857e0, 2) WHEN 5 THEN round(n, 2) WHEN 6 THEN round(n*2529.289e0, 2) ELSE n END AS m2,
    CASE l_linenumber%8 WHEN 0 THEN 'compound_bigha_biswa' WHEN 1 THEN 'bigha' WHEN 2 THEN 'biswa' WHEN 3 THEN 'guntha' WHEN 4 THEN 'kanal'
      WHEN 5 THEN 'sqm' WHEN 6 THEN 'बीघा' ELSE 'raw_numeric' END AS unit FROM q)"""


@query("t8_area_text", with_sql("fx_area_text", AREA_SQL + "SELECT * FROM parsed"))
def t8(spark, sf):
    rows = st.area_to_m2(view(spark, sf, "fx_area_text"), "raw_area", "a")
    return rows.select("l_orderkey", "l_linenumber", F.round("a.m2", 2).alias("m2"), F.col("a.unit").alias("unit"))


@query(
    "t9_area_units",
    with_sql(
        "fx_area_text",
        AREA_SQL
        + """SELECT unit, count(*) AS n, round(sum(round(m2/10000e0, 4)), 2) AS hectares, round(sum(round(m2/4046.856e0, 4)), 2) AS acres
        FROM parsed GROUP BY unit""",
    ),
)
def t9(spark, sf):
    rows = st.area_to_m2(view(spark, sf, "fx_area_text"), "raw_area", "a")
    rows = rows.select(F.col("a.unit").alias("unit"), *st.derived_areas("a.m2"))
    return rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("hectares"), 2).alias("hectares"), F.round(F.sum("acres"), 2).alias("acres")
    )


FIXED_POINTS = """, p AS (SELECT row_id, CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lon ELSE lat END AS lat,
    CASE WHEN lon BETWEEN 6 AND 38 AND lat BETWEEN 68 AND 98 THEN lat ELSE lon END AS lon FROM fx_point_row)"""
_bit = "(((CASE WHEN (5*j+{b})%2=0 THEN gx ELSE gy END) >> ((CASE WHEN (5*j+{b})%2=0 THEN 27 ELSE 26 END) - (5*j+{b})//2)) & 1) * {w}"
_digit = " + ".join(_bit.format(b=b, w=16 >> b) for b in range(5))
ULPIN_SQL = (
    FIXED_POINTS
    + f""", g AS (SELECT *, CAST(floor((lon+180)/360*268435456) AS BIGINT) AS gx, CAST(floor((lat+90)/180*134217728) AS BIGINT) AS gy,
      CAST(floor(abs(lat*1000000)) AS BIGINT)%1000 AS lam, CAST(floor(abs(lon*1000000)) AS BIGINT)%1000 AS lom FROM p),
    c AS (SELECT *, upper(array_to_string(list_transform(range(11), lambda j: substr('{ul.GEOHASH_DIGITS}', CAST({_digit} AS INT)+1, 1)), ''))
      || substr('{ul.DIGITS}', CAST((lam+lom)%34 AS INT)+1, 1) || substr('{ul.DIGITS}', CAST((lam*3+lom*7)%34 AS INT)+1, 1) AS core FROM g),
    u AS (SELECT row_id, lat, lon, core || substr('{ul.DIGITS}', CAST(list_sum(list_transform(range(1,14),
      lambda i: greatest(instr('{ul.DIGITS}', core[i])-1, 0)*i*3))%34 AS INT)+1, 1) AS ulpin FROM c)"""
)


def _ulpins(spark, sf):
    rows = view(spark, sf, "fx_point_row").withColumn("geom", point_geometry("lon", "lat"))
    return ul.assign_ulpin(rows.withColumn("geom", fix_inversion("geom")))


@query("t10_assign_ulpin", with_sql("fx_point_row", ULPIN_SQL + "SELECT row_id, ulpin FROM u"))
def t10(spark, sf):
    return _ulpins(spark, sf).select("row_id", "ulpin")


@query(
    "t11_validate_ulpin",
    with_sql("fx_point_row", ULPIN_SQL + "SELECT row_id, row_id%3 = 0 AS valid FROM u"),
)
def t11(spark, sf):
    """Identifiers kept, cut short or with a check character that cannot be right."""
    rows = _ulpins(spark, sf)
    wrong = F.concat(F.substring("ulpin", 1, 13), F.when(F.substring("ulpin", 14, 1) == "0", "1").otherwise("0"))
    code = F.when(F.col("row_id") % 3 == 0, F.lower("ulpin")).when(F.col("row_id") % 3 == 1, wrong).otherwise(F.substring("ulpin", 1, 12))
    return rows.select("row_id", ul.ulpin_valid(code).alias("valid"))


@query(
    "t12_decode_ulpin",
    with_sql(
        "fx_point_row",
        ULPIN_SQL
        + """, d AS (SELECT row_id, CAST(floor((lon+180)/360*268435456) AS BIGINT) AS x, CAST(floor((lat+90)/180*134217728) AS BIGINT) AS y FROM p)
        SELECT row_id, round(-90 + (y+0.5e0)*180/134217728, 7) AS latitude, round(-180 + (x+0.5e0)*360/268435456, 7) AS longitude,
          round(-90 + y*180e0/134217728, 7) AS min_lat, round(-180 + (x+1)*360e0/268435456, 7) AS max_lon FROM d""",
    ),
)
def t12(spark, sf):
    rows = ul.with_decoded(_ulpins(spark, sf), "ulpin", "d")
    return rows.select("row_id", *[F.col(f"d.{n}").alias(n) for n in ("latitude", "longitude", "min_lat", "max_lon")])


@query("t13_nan_to_null", "SELECT s_suppkey, CASE WHEN s_suppkey%3<>0 THEN s_acctbal END AS balance FROM supplier")
def t13(spark, sf):
    value = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    return nan_to_null(spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", value.alias("balance")))


@query(
    "t16_flexible_input",
    """SELECT p_partkey, CASE p_partkey%4 WHEN 3 THEN 2 WHEN 0 THEN 2 ELSE 1 END AS n, CASE p_partkey%4 WHEN 3 THEN 2 WHEN 0 THEN 2 ELSE 1 END * (77e0 + p_size) AS x FROM part""",
)
def t16(spark, sf):
    """Collections, features, bare geometries and lists, one form per part."""
    bare = F.concat(F.lit('{"type":"Point","coordinates":['), (F.col("p_size") + 77).cast("string"), F.lit(",28]}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"a":"1"},"geometry":'), bare, F.lit("}"))
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit(","), feature, F.lit("]}")))
        .when(k == 1, feature)
        .when(k == 2, bare)
        .otherwise(F.concat(F.lit("["), feature, F.lit(","), bare, F.lit("]")))
    )
    rows = rd.flexible_features(_parts(spark, sf).select("p_partkey", text.alias("doc")), "doc")
    x = F.col("geom.parts")[0]["shell"][0]["x"]
    return rows.groupBy("p_partkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(x).alias("x"))

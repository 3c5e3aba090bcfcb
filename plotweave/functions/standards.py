"""Land-record vocabulary: area units and field names, and their column parsers."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.functions.geometry import col
from plotweave.functions.text import _fold_key, ratio

# Area unit -> square metres, in matching order.
AREA_UNITS = {
    "sqm": 1.0,
    "sq_m": 1.0,
    "sq_meter": 1.0,
    "sq_meters": 1.0,
    "square_meter": 1.0,
    "वर्ग मीटर": 1.0,
    "मी²": 1.0,
    "hectare": 10000.0,
    "ha": 10000.0,
    "हेक्टेयर": 10000.0,
    "acre": 4046.8564224,
    "ac": 4046.8564224,
    "एकड़": 4046.8564224,
    "sqft": 0.092903,
    "sq_ft": 0.092903,
    "square_feet": 0.092903,
    "वर्ग फुट": 0.092903,
    "bigha": 2529.289,
    "pucca_bigha": 2529.289,
    "kacha_bigha": 843.096,
    "बीघा": 2529.289,
    "पक्का बीघा": 2529.289,
    "कच्चा बीघा": 843.096,
    "biswa": 126.464,
    "बिस्वा": 126.464,
    "biswansi": 6.323,
    "बिस्वांसी": 6.323,
    "katha": 126.464,
    "कट्ठा": 126.464,
    "कट्टा": 126.464,
    "dhur": 6.323,
    "धूर": 6.323,
    "kanal": 505.857,
    "कनाल": 505.857,
    "marla": 25.293,
    "मरला": 25.293,
    "sarsahi": 2.81,
    "guntha": 101.171,
    "गुंठा": 101.171,
    "गुंटा": 101.171,
    "guntas": 101.171,
    "vigha": 1936.0,
    "विघा": 1936.0,
    "cent": 40.4686,
    "सेंट": 40.4686,
    "ground": 222.967,
    "ग्राउन्ड": 222.967,
    "ankanam": 6.689,
}
SQM_PER_HECTARE = 10000.0
SQM_PER_ACRE = 4046.856

# Canonical field -> source field names.
FIELD_NAMES = {
    "parcel_id": [
        "khasra", "khasra_no", "khasra_number", "gata", "gata_no", "gata_sankhya", "plot_no", "survey_no",
        "survey_number", "chalta_no", "taram_no", "khatauni_khasra", "dag_no", "खसरा", "खसरा नं", "खसरा संख्या",
        "गाटा", "गाटा संख्या", "गट क्रमांक", "प्लॉट नं", "प्लॉट संख्या", "सर्वे नंबर", "दाघ नं", "చాల్తా నంబరు",
        "సర్వే నంబరు",
    ],
    "khata_number": [
        "khata", "khata_no", "khatauni", "khatauni_no", "khewat", "khewat_no", "jamabandi", "ror_id", "patta_no",
        "खाता", "खाता नं", "खाता संख्या", "खतौनी", "खतौनी नं", "खेवट", "खेवट नं", "जमाबंदी", "पट्टा संख्या",
        "ఖాతా నంబరు", "பட்டா எண்",
    ],
    "owner": [
        "malik", "owner_name", "kashthkar", "pattadar", "rayat", "bhoomi_swami", "khatedar", "tenure_holder",
        "occupant", "kabza", "dharak", "nam", "मालिक", "मालिक का नाम", "काश्तकार", "पट्टेदार", "खातेदार",
        "भूमि स्वामी", "खातेदाराचे नाव", "रैयत", "భూమి యజమాని", "பட்டாதாரர் பெயர்",
    ],
    "land_use": [
        "kism", "upayog", "prayojan", "land_type", "zoning", "classification", "usage", "vargikaran",
        "dharana_prakar", "किस्म", "किस्म ज़मीन", "उपयोग", "भूमि उपयोग", "प्रयोजन", "वर्गीकरण", "धोरण प्रकार",
        "நில வகைப்பாடு",
    ],
    "area": [
        "rakba", "kshetraphal", "pariman", "visteernam", "extent", "map", "area_raw", "रकबा", "क्षेत्रफल",
        "रकबा बीघा", "विस्तार", "విస్తీర్ణం", "பரப்பளவு",
    ],
    "village": [
        "mauza", "gram", "gaon", "mohalla", "village_name", "revenue_village", "deh", "मौजा", "ग्राम", "गांव",
        "गाँव", "मोहाल्ला", "గ్రామం", "கிராமம்",
    ],
    "tehsil": [
        "tehsil", "taluka", "mandal", "sub_district", "circle", "anchal", "तहसील", "तालुका", "मंडल", "अंचल",
        "తాలూకా", "வட்டம்",
    ],
    "district": ["jila", "district", "zila", "जिला", "जिल्हा", "జిల్లా", "மாவட்டம்"],
}

# Per layer type, canonical field -> source field names.
LAYER_FIELDS = {
    "cadastral": {
        "parcel_id": ["parcel_id", "plot_no", "plot_number", "feature_id", "id"],
        "land_use": ["land_use", "landuse", "use_type"],
        "owner": ["owner", "owner_name"],
    },
    "municipal": {
        "parcel_id": ["parcel_id", "property_id", "pin", "plot_no", "feature_id", "id"],
        "zone": ["zone", "zoning", "ward", "subzone"],
        "address": ["address", "addr", "street", "locality", "location"],
    },
    "building": {
        "parcel_id": ["parcel_id", "building_id", "bldg_id", "feature_id", "id"],
        "building_type": ["building_type", "type", "structure_type", "usage"],
        "status": ["status", "condition", "occupancy", "building_status"],
    },
}

_NUMBER = r"(\d+(?:\.\d+)?)"
# A bigha amount followed by a biswa amount.
COMPOUND = (
    _NUMBER + r"\s*(?:bigha|बीघा|vigha|विघा)\s*(?:and|,|\+)?\s*" + _NUMBER + r"\s*(?:biswa|बिस्वा|कट्टा|katha)"
)
# Decimal digits of every script, from the character database.
_DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd")
_ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def units_table(spark: SparkSession) -> DataFrame:
    """unit, square metres, hectares and acres per unit."""
    df = spark.createDataFrame(list(AREA_UNITS.items()), "unit string, sqm double")
    return df.select("unit", "sqm", *derived_areas("sqm"))


def derived_areas(sqm) -> list[Column]:
    return [
        F.round(col(sqm) / SQM_PER_HECTARE, 4).alias("hectares"),
        F.round(col(sqm) / SQM_PER_ACRE, 4).alias("acres"),
    ]


def area_to_m2(df: DataFrame, column: str, name: str = "parsed", numeric: bool = False) -> DataFrame:
    """Add struct(m2, unit) for an area text column.

    A bigha-and-biswa compound first, then the first unit in table order that follows
    a number, then a bare number. The cleaned text is its own projection, so the long
    chain of tests reads one value; a substring test spares most regular expressions.
    """
    raw = F.col(column)
    if numeric:
        return df.withColumn(
            name,
            F.when(raw.isNull(), _area(F.lit(None), "unknown")).otherwise(_area(raw.cast("double"), "numeric")),
        )
    text = F.col("_text")

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(text, pattern, group).cast("double")

    both = number(COMPOUND, 1) * AREA_UNITS["bigha"] + number(COMPOUND, 2) * AREA_UNITS["biswa"]
    holds = F.lit(False)
    for word in ("bigha", "बीघा", "vigha", "विघा"):
        holds = holds | text.contains(word)
    out = F.when(text.isNull(), _area(F.lit(None), "unknown")).when(
        holds & text.rlike(COMPOUND), _area(F.round(both, 2), "compound_bigha_biswa")
    )
    for unit, factor in AREA_UNITS.items():
        pattern = _NUMBER + r"\s*" + re.escape(unit).replace("\\ ", " ")
        out = out.when(
            text.contains(unit) & text.rlike(pattern), _area(F.round(number(pattern) * factor, 2), unit)
        )
    out = out.when(text.rlike(_NUMBER), _area(number(_NUMBER), "raw_numeric")).otherwise(
        _area(F.lit(None), "unparseable")
    )
    df = df.withColumn("_text", F.regexp_replace(F.translate(F.lower(F.trim(raw)), _DIGITS, _ASCII_DIGITS), r"(?U)\s", " "))
    return df.withColumn(name, out).drop("_text")


def _area(m2: Column, unit: str) -> Column:
    return F.struct(m2.cast("double").alias("m2"), F.lit(unit).alias("unit"))


_MATCH_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("canonical", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("method", T.StringType()),
        ]
    )
)
_MATCH_ARROW = pa.list_(pa.struct([("canonical", pa.string()), ("score", pa.float64()), ("method", pa.string())]))


def field_matcher(names: dict[str, list[str]], threshold: float, fold=_fold_key):
    """UDF naming the canonical field of every key of a key array.

    Exact folded hit first, else the most similar known name at or above the threshold,
    the earlier name winning ties. Keys repeat from row to row, so every worker looks
    each distinct key of a batch up once; no shuffle is needed.
    """
    known: dict[str, str] = {}
    for canonical, words in names.items():
        for w in words:
            known[fold(w)] = canonical

    def lookup(key: str) -> dict:
        folded = fold(key)
        if folded in known:
            return {"canonical": known[folded], "score": 100.0, "method": "exact"}
        best, score = None, -1.0
        for word in known:
            s = ratio(folded, word)
            if s > score:
                best, score = word, s
        if best is not None and score >= threshold:
            return {"canonical": known[best], "score": score, "method": "fuzzy"}
        return {"canonical": None, "score": score, "method": "unmapped"}

    @F.arrow_udf(_MATCH_TYPE)
    def match(keys: pa.Array) -> pa.Array:
        memo: dict[str, dict] = {}
        out = []
        for row in keys.to_pylist():
            for k in row or []:
                if k not in memo:
                    memo[k] = lookup(k)
            out.append([memo[k] for k in row or []])
        return pa.array(out, type=_MATCH_ARROW)

    return match

"""Writers and catalog views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.geometry import to_geojson

# Column titles of the two CSV exports.
REGISTRY_COLUMNS = {
    "Harmonized ID": "harmonized_id",
    "Parcel ID": "parcel_id",
    "ULPIN / Bhu-Aadhar": "ulpin",
    "Owner": "owner",
    "Land Use": "land_use",
    "Zone": "zone",
    "Address": "address",
    "Area (sqm)": "area",
    "Confidence (%)": "confidence",
    "Status": "harmonization_status",
    "Operation": "operation",
}
REGISTRY_DEFAULTS = {"confidence": "95", "harmonization_status": "certified", "operation": "harmonized"}
AUDIT_COLUMNS = {
    "Harmonized ID": "harmonized_id",
    "Parcel ID": "parcel_id",
    "Cadastral Source": "cadastral_id",
    "Municipal Source": "municipal_id",
    "Owner": "owner",
    "Classification": "land_use",
    "Zone": "zone",
    "Address": "address",
    "Area (m2)": "area",
    "Confidence": "confidence",
    "Status": "harmonization_status",
}


def _text(df: DataFrame, name: str, default: str = "") -> Column:
    """Column as text; a whole number has no decimals, so a confidence of 90.0 reads 90."""
    value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    if name == "confidence":
        value = F.regexp_replace(value, r"\.0$", "")
    return F.coalesce(value, F.lit(default))


def registry_rows(harmonized: DataFrame) -> DataFrame:
    """Eleven registry columns, defaults filled in."""
    return harmonized.select(
        *[_text(harmonized, c, REGISTRY_DEFAULTS.get(c, "")).alias(title) for title, c in REGISTRY_COLUMNS.items()]
    )


def audit_rows(harmonized: DataFrame) -> DataFrame:
    """Audit columns with both source ids and the confidence as a percentage."""
    out = []
    for title, c in AUDIT_COLUMNS.items():
        if c == "confidence":
            value = F.concat(_text(harmonized, c, "92"), F.lit("%"))
        else:
            value = _text(harmonized, c, "certified" if c == "harmonization_status" else "")
        out.append(value.alias(title))
    return harmonized.select(*out)


def export_registry(harmonized: DataFrame, path: str, fmt: str = "geojson") -> None:
    if fmt.lower() == "csv":
        registry_rows(harmonized).write.mode("overwrite").option("header", True).csv(path)
    else:
        write_geojson(harmonized.withColumnRenamed("harmonized_id", "feature_id"), path)


def export_audit_csv(harmonized: DataFrame, path: str) -> None:
    audit_rows(harmonized).write.mode("overwrite").option("header", True).csv(path)


def _member(value: Column, name: str) -> Column:
    """``"name":value`` as JSON text, the value with its own type; null is written as null."""
    whole = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def geojson_rows(layer: DataFrame) -> DataFrame:
    """One GeoJSON feature text per row; attributes win over columns; null geometry is skipped.

    Columns keep their types (numbers, booleans, arrays, structs). Attributes are a map of
    texts and stay texts.
    """
    fixed = [c for c in layer.columns if c not in ("geom", "attributes")]
    members = [_member(F.col(c), c) for c in fixed]
    if "attributes" in layer.columns:
        extra = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
        members = [F.when(~F.map_contains_key(extra, c), m) for c, m in zip(fixed, members)]
        text = F.to_json(extra, {"ignoreNullFields": "false"})
        members.append(F.when(F.size(extra) > 0, F.substring(text, F.lit(2), F.length(text) - 2)))
    body = F.concat(
        F.lit('{"type":"Feature",'),
        _member(F.col("feature_id").cast("string"), "id"),
        F.lit(',"geometry":'),
        to_geojson("geom"),
        F.lit(',"properties":{'),
        F.concat_ws(",", *members),
        F.lit("}}"),
    )
    return layer.where("geom is not null").select(body.alias("value"))


def write_geojson(layer: DataFrame, path: str) -> None:
    """GeoJSON lines, one feature per line, written by all tasks in parallel."""
    geojson_rows(layer).write.mode("overwrite").text(path)


def write_layer(layer: DataFrame, path: str) -> None:
    """Replace only the datasets present in ``layer``; running it twice changes nothing."""
    layer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def replace_dataset(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored features with the datasets of ``fresh`` replaced by it."""
    renewed = fresh.select("dataset_id").distinct()
    return stored.join(renewed, "dataset_id", "left_anti").unionByName(fresh)


def catalog(datasets: DataFrame, sources: DataFrame) -> DataFrame:
    """Datasets with source name and file name, newest first."""
    names = sources.select("source_id", F.col("name").alias("source_name"))
    filename = F.coalesce(
        F.element_at(F.split("file_path", "/"), -1), F.concat(F.lit("dataset_"), F.col("id").cast("string"))
    )
    return datasets.join(names, "source_id", "left").withColumn("filename", filename).orderBy(F.desc("id"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating-point NaN becomes null, as exports need it."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )

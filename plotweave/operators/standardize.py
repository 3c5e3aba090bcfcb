"""Source attributes onto the canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.projection import with_area_utm
from plotweave.functions.standards import FIELD_NAMES, LAYER_FIELDS, area_to_m2, field_matcher
from plotweave.functions.ulpin import assign_ulpin

# Similarity thresholds, seeded fields and keys that are never matched by likeness.
VOCABULARY_THRESHOLD = 75.0
LAYER_THRESHOLD = 70.0
SEEDED = ["parcel_id", "owner", "land_use", "khata_number", "village"]
IDENTIFIERS = ["ulpin", "bhu_aadhar"]
PARCEL_KEYS = ["parcel_id", "plot_no", "khasra", "खसरा"]


def _last_wins(entries: Column) -> Column:
    """Map from (key, value) entries, a later entry replacing an earlier one."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(keys, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"])
    return F.map_from_arrays(keys, values)


def _entries(props: Column) -> Column:
    return F.map_entries(props)


def map_fields(df: DataFrame, column: str = "properties", threshold: float = VOCABULARY_THRESHOLD) -> DataFrame:
    """Vernacular names to canonical ones: ``mapped``, ``area_sqm``, ``rest`` and the per-key ``matches``.

    The area field is parsed to square metres; keys nobody knows are kept in ``rest``.
    """
    entries = _entries(F.col(column))
    df = df.withColumn("_e", entries)
    df = df.withColumn("matches", field_matcher(FIELD_NAMES, threshold)(F.transform("_e", lambda e: e["key"])))
    both = F.zip_with(
        "_e",
        "matches",
        lambda e, m: F.struct(m["canonical"].alias("key"), e["value"].alias("value"), e["key"].alias("raw")),
    )
    df = df.withColumn("_m", both)
    hits = F.filter("_m", lambda e: e["key"].isNotNull())
    df = df.withColumns(
        {
            "mapped": _last_wins(hits),
            "rest": F.map_from_entries(
                F.transform(F.filter("_m", lambda e: e["key"].isNull()), lambda e: F.struct(e["raw"].alias("key"), e["value"]))
            ),
        }
    )
    df = df.withColumn("_a", F.try_element_at("mapped", F.lit("area")))
    df = area_to_m2(df, "_a", "_parsed")
    return df.withColumn("area_sqm", F.col("_parsed.m2")).drop("_e", "_m", "_a", "_parsed")


def standardize(df: DataFrame, layer_type: str, threshold: float = LAYER_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(features, unmapped keys) of one layer type; df has dataset_id, feature_index, properties, geom."""
    if layer_type not in LAYER_FIELDS:
        raise ValueError(f"no field mapping for layer type '{layer_type}'")
    df = map_fields(df)
    matcher = field_matcher(LAYER_FIELDS[layer_type], threshold, fold=str.lower)
    df = df.withColumn("_e", _entries(F.col("properties")))
    df = df.withColumn("_l", matcher(F.transform("_e", lambda e: e["key"])))

    seeds = F.array(
        *[F.struct(F.lit(n).alias("key"), F.try_element_at("mapped", F.lit(n)).alias("value")) for n in SEEDED]
    )
    seeds = F.filter(seeds, lambda s: s["value"].isNotNull() & (s["value"] != ""))

    def target(e: Column, m: Column) -> Column:
        low = F.lower(e["key"])
        return F.when(low.isin(*IDENTIFIERS), low).when(low.isin(*PARCEL_KEYS), "parcel_id").otherwise(m["canonical"])

    named = F.zip_with(
        "_e", "_l", lambda e, m: F.struct(target(e, m).alias("key"), e["value"].alias("value"), e["key"].alias("raw"))
    )
    df = df.withColumns({"_seeds": seeds, "_named": named})
    hits = F.transform(F.filter("_named", lambda e: e["key"].isNotNull()), lambda e: F.struct(e["key"], e["value"]))
    df = df.withColumn("_final", _last_wins(F.concat("_seeds", hits)))
    seeded = F.transform("_seeds", lambda s: s["key"])
    lost = F.filter("_named", lambda e: e["key"].isNull() & ~F.array_contains(seeded, e["raw"]))
    df = df.withColumn("unmapped_fields", F.transform(lost, lambda e: e["raw"]))
    unknown = F.concat(F.lit("unknown-"), F.col("feature_index").cast("string"))
    df = df.withColumn("feature_id", F.coalesce(F.try_element_at("_final", F.lit("parcel_id")), unknown))
    df = with_area_utm(assign_ulpin(df), "geom", "area")
    kept = F.map_filter("_final", lambda key, _: ~key.isin("parcel_id", *IDENTIFIERS))
    ids = F.create_map(F.lit("ulpin"), F.col("ulpin"), F.lit("bhu_aadhar"), F.col("bhu_aadhar"))
    features = df.select(
        "dataset_id", "feature_index", "feature_id", "geom", "area", F.map_concat(kept, ids).alias("attributes")
    )
    unmapped = df.where(F.size("unmapped_fields") > 0).select("dataset_id", "feature_index", "unmapped_fields")
    return features, unmapped

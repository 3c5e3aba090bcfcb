"""The harmonized layer: build, edit by merge and split, look up, export columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import area_local_m2, bbox, is_empty, rect
from plotweave.functions.ulpin import assign_ulpin
from plotweave.operators.reconcile import side_of
from plotweave.operators.union import dissolve
from plotweave.session import cut

PAD = 0.001


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


# Attributes every harmonized parcel has, also when its source lacks them.
ATTRIBUTES = ("owner", "land_use", "zone", "address")
_MADE = (
    "harmonized_id", "parcel_id", "ulpin", "bhu_aadhar", "source_feature_a", "source_feature_b", "area", "confidence",
    "harmonization_status", "operation", "lineage", "geom", "feature_id", "dataset_id", "feature_b", "dataset_a", "dataset_b",
)


def harmonize(matches: DataFrame, features: DataFrame, min_score: int = 70) -> DataFrame:
    """Pairs at or above ``min_score`` with the geometry and all attributes of feature A.

    Features are found by dataset and id where the matches carry ``dataset_a``; rows then
    have the dataset as well.
    """
    names, keys = side_of(features, matches, "a")
    rest = [c for c in matches.columns if c == "feature_b"]
    chosen = matches.where(F.col("score") >= min_score).select(
        *[F.col(k).alias(c) for c, k in names.items() if k in keys], *rest, F.col("score").alias("confidence")
    )
    on = [c for c, k in names.items() if k in keys]
    attributes = [c for c in features.columns if c not in _MADE and c not in ATTRIBUTES]
    rows = assign_ulpin(chosen.join(features.where(~is_empty("geom")), on))
    lineage = F.struct(
        F.array("feature_id", "feature_b").alias("sources"), F.lit("harmonized").alias("operation")
    )
    return rows.select(
        F.concat(F.lit("HARM-"), "feature_id").alias("harmonized_id"),
        F.col("feature_id").alias("parcel_id"),
        *[c for c in on if c == "dataset_id"],
        "ulpin",
        "bhu_aadhar",
        F.col("feature_id").alias("source_feature_a"),
        F.col("feature_b").alias("source_feature_b"),
        *[_or_null(features, n).alias(n) for n in ATTRIBUTES],
        "area",
        F.col("confidence").cast("double").alias("confidence"),
        F.lit("certified_reconciled").alias("harmonization_status"),
        F.lit("harmonized").alias("operation"),
        lineage.alias("lineage"),
        "geom",
        *attributes,
    )


def _named_by(features: DataFrame, requests: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features under the key of ``requests``: dataset and id if these carry a dataset, else the id of the first dataset."""
    if "dataset_id" in requests.columns or "dataset_id" not in features.columns:
        return features, [c for c in ("dataset_id", "feature_id") if c in requests.columns]
    others = [c for c in features.columns if c != "feature_id"]
    first = features.groupBy("feature_id").agg(F.min_by(F.struct(*others), "dataset_id").alias("_f"))
    return first.select("feature_id", "_f.*"), ["feature_id"]


def _not_found(name: str) -> Column:
    return F.concat(F.lit("Parcel with ID '"), F.col(name), F.lit("' not found in active registry"))


def apply_edits(harmonized: DataFrame, superseded: DataFrame, custom: DataFrame) -> DataFrame:
    """Leave out superseded parcels (parcel_id) and append the ones that replace them.

    Where both tables carry dataset_id, a parcel is superseded in its own dataset only.
    """
    also = ["dataset_id"] if "dataset_id" in harmonized.columns and "dataset_id" in superseded.columns else []
    kept = harmonized.join(superseded.select("parcel_id", *also).distinct(), ["parcel_id", *also], "left_anti")
    gone = superseded.select(F.col("parcel_id").alias("harmonized_id"), *also).distinct()
    kept = kept.join(gone, ["harmonized_id", *also], "left_anti").select(harmonized.columns)
    return kept.unionByName(custom, allowMissingColumns=True)


def merge_parcels(features: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged parcels, error rows).

    groups: (group_id, pos, feature_id, target_id, combined_owner), the last two nullable,
    and dataset_id if ids repeat between datasets. A group with fewer than two ids or with an
    unknown one is refused and gives an error row. Geometry is a distributed union;
    attributes are ordered aggregates.
    """
    known, on = _named_by(features, groups)
    attributes = [_or_null(known, n).alias(n) for n in ATTRIBUTES]
    rows = groups.join(known.select(*on, "geom", *attributes, F.lit(True).alias("_known")), on, "left")
    counted = cut(
        rows.groupBy("group_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("feature_id", F.when(F.col("_known").isNull(), F.col("pos"))).alias("missing"),
        )
    )
    # Error texts, and the defaults of merged parcels below.
    few = F.when(F.col("n") < 2, F.lit("At least 2 parcel IDs are required for a parcel merge."))
    errors = counted.select("group_id", F.coalesce(few, _not_found("missing")).alias("error")).where("error is not null")
    accepted = counted.where("n >= 2 and missing is null").select("group_id")
    rows = rows.join(accepted, "group_id", "left_semi").drop("_known")
    geom = dissolve(rows.select("group_id", "geom"), "group_id")

    def first(name: str) -> Column:
        given = F.when(F.col(name) != "", F.col(name))
        return F.min_by(given, F.when(given.isNotNull(), F.col("pos"))).alias(f"_{name}")

    said = F.when((F.col("owner") != "") & (F.col("owner") != "null"), F.col("owner"))
    owners = rows.select("group_id", "pos", said.alias("owner")).where("owner is not null")
    owners = owners.groupBy("group_id", "owner").agg(F.min("pos").alias("pos"))
    owners = owners.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "owner"))).alias("o"))
    facts = rows.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "feature_id"))).alias("members"),
        *[first(n) for n in ("land_use", "zone", "address")],
        F.max("target_id").alias("target_id"),
        F.max("combined_owner").alias("combined_owner"),
    )
    merged = facts.join(owners, "group_id", "left").join(geom, "group_id")
    ids = F.transform("members", lambda m: m["feature_id"])
    merged = assign_ulpin(merged.withColumn("ids", ids)).withColumn("area", F.round(area_local_m2("geom"), 2))
    pid = F.coalesce("target_id", F.concat(F.lit("MERGED-"), F.array_join("ids", "-")))
    listed = F.array_join(F.transform("o", lambda v: v["owner"]), " & ")
    merged = merged.withColumn("parcel_id", pid)
    result = merged.select(
        "group_id",
        F.concat(F.lit("HARM-"), "parcel_id").alias("harmonized_id"),
        "parcel_id",
        "ulpin",
        "bhu_aadhar",
        F.coalesce("combined_owner", listed, F.lit("Joint Ownership")).alias("owner"),
        F.coalesce("_land_use", F.lit("Residential")).alias("land_use"),
        F.coalesce("_zone", F.lit("Unified Zone")).alias("zone"),
        F.coalesce("_address", F.concat(F.lit("Amalgamated Plot "), "parcel_id")).alias("address"),
        "area",
        F.lit(98.5).alias("confidence"),
        F.lit("APPROVED").alias("harmonization_status"),
        F.lit("merged").alias("operation"),
        F.struct(F.col("ids").alias("sources"), F.lit("merged").alias("operation")).alias("lineage"),
        "geom",
    )
    return result, errors


def split_parcels(features: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strips, error rows) for requests (feature_id, parts, direction), and dataset_id if ids repeat.

    Equal strips; a request for fewer than 2 or more than 10 parts or for an unknown
    parcel gives an error row.
    """
    known, on = _named_by(features, requests)
    # Error texts, and the defaults of strips below.
    wrong = (
        F.when(F.col("parts") < 2, "Split must create at least 2 parts.")
        .when(F.col("parts") > 10, "Split must create at most 10 parts.")
        .when(F.col("parts").isNull(), "Split must create at least 2 parts.")
    )
    asked = requests.withColumn("error", wrong)
    found = known.select(*on, F.lit(True).alias("_known"))
    errors = asked.join(found, on, "left").select(
        *requests.columns, F.coalesce("error", F.when(F.col("_known").isNull(), _not_found("feature_id"))).alias("error")
    )
    rows = asked.where("error is null").drop("error").join(known, on).withColumn("b", bbox("geom"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    b, n, i = F.col("b"), F.col("parts"), F.col("i")

    def at(low: str, high: str, step: Column) -> Column:
        return b[low] + step * (b[high] - b[low]) / n

    flat = F.col("direction") == "horizontal"
    strip = rect(
        F.when(flat, b["minx"] - PAD).otherwise(at("minx", "maxx", i - 1)),
        F.when(flat, at("miny", "maxy", i - 1)).otherwise(b["miny"] - PAD),
        F.when(flat, b["maxx"] + PAD).otherwise(at("minx", "maxx", i)),
        F.when(flat, at("miny", "maxy", i)).otherwise(b["maxy"] + PAD),
    )
    rows = rows.withColumn("geom", k.clip("geom", strip)).where("geom is not null")
    rows = assign_ulpin(rows).withColumn("area", F.round(area_local_m2("geom"), 2))
    pid = F.concat_ws("/", "feature_id", i.cast("string"))

    def said(name: str, default: str) -> Column:
        return F.coalesce(_or_null(features, name), F.lit(default))

    strips = rows.select(
        F.concat(F.lit("HARM-"), pid).alias("harmonized_id"),
        pid.alias("parcel_id"),
        "ulpin",
        "bhu_aadhar",
        F.concat(said("owner", "Owner"), F.lit(" (Subdivision "), i.cast("string"), F.lit(")")).alias("owner"),
        said("land_use", "Residential").alias("land_use"),
        said("zone", "Zone R-1").alias("zone"),
        F.concat(said("address", "Sector 14"), F.lit(" - Lot "), i.cast("string")).alias("address"),
        "area",
        F.lit(95.0).alias("confidence"),
        F.lit("APPROVED").alias("harmonization_status"),
        F.lit("split").alias("operation"),
        F.struct(F.array("feature_id").alias("sources"), F.lit("split").alias("operation")).alias("lineage"),
        "geom",
    )
    return strips, errors.where("error is not null")


def find_parcels(wanted: DataFrame, custom: DataFrame, features: DataFrame) -> DataFrame:
    """Where each parcel_id comes from: an edit first, then the feature table, else an error."""
    edits = custom.select("parcel_id", F.lit("custom").alias("_c"), F.col("owner").alias("_co"))
    base = features.select(F.col("feature_id").alias("parcel_id"), F.lit("features").alias("_f"), F.col("owner").alias("_fo"))
    rows = wanted.join(edits, "parcel_id", "left").join(base, "parcel_id", "left")
    missing = _not_found("parcel_id")
    origin = F.coalesce("_c", "_f")
    return rows.select(
        "parcel_id",
        origin.alias("origin"),
        F.when(F.col("_c").isNotNull(), F.col("_co")).otherwise(F.col("_fo")).alias("owner"),
        F.when(origin.isNull(), missing).alias("error"),
    )


def trace_parcels(wanted: DataFrame, lineage: DataFrame) -> DataFrame:
    """Where parcels have gone by now: (parcel_id, current_id, cyclic), a row per wanted and current parcel.

    ``lineage`` (source_id, parcel_id) holds one row per merge or split step; a parcel is
    current if nothing came from it, so a parcel without steps is its own. ``cyclic`` marks
    parcels whose steps lead into a circle; ``current_id`` is null if they lead nowhere else.
    Repeated and null steps count once and not at all. Only wanted parcels are followed,
    two steps a round, so rounds are half the longest history; only row counts reach the driver.
    """
    steps = cut(lineage.select("source_id", "parcel_id").where("source_id is not null and parcel_id is not null").distinct())
    onward = steps.withColumnsRenamed({"source_id": "node", "parcel_id": "next"})

    def follow(rows: DataFrame) -> DataFrame:
        return rows.join(onward, "node").select("root", F.col("next").alias("node"))

    new = cut(wanted.select(F.col("parcel_id").alias("root"), F.col("parcel_id").alias("node")).where("root is not null").distinct())
    seen = new
    while new.limit(1).count():
        once = follow(new)
        new = cut(once.unionByName(follow(once)).distinct().join(seen, ["root", "node"], "left_anti"))
        seen = seen.unionByName(new)

    # Steps to current parcels are taken away until none is left: what stays leads into circles.
    left, n = steps, steps.count()
    while n:
        fewer = left
        for _ in range(2):
            fewer = fewer.join(fewer.select(F.col("source_id").alias("parcel_id")).distinct(), "parcel_id", "left_semi")
        left, before = cut(fewer), n
        n = left.count()
        if n == before:
            break
    stuck = left.select(F.col("source_id").alias("root"), F.lit(True).alias("_stuck")).distinct()
    ends = seen.join(onward.select("node"), "node", "left_anti").withColumnRenamed("node", "current_id")
    roots = wanted.select(F.col("parcel_id").alias("root")).where("root is not null").distinct()
    return roots.join(ends, "root", "left").join(stuck, "root", "left").select(
        F.col("root").alias("parcel_id"), "current_id", F.coalesce("_stuck", F.lit(False)).alias("cyclic")
    )

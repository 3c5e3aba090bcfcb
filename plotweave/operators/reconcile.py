"""Conflicts, recommendations and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.geometry import col
from plotweave.functions.kernels import is_valid
from plotweave.functions.text import numeric_value
from plotweave.operators.spatial_join import candidates
from plotweave.session import cut

# Closed sets and names of the conflict and recommendation contracts.
CONFLICT_TYPES = ["geometry", "area", "attribute", "missing_feature", "duplicate", "temporal"]
SEVERITIES = ["informational", "low", "medium", "high"]
CONFIDENCE = {"informational": 60, "low": 70, "medium": 80, "high": 90}
DECISIONS = {
    "APPROVED": ["APPROVED", "ACCEPT"],
    "REJECTED": ["REJECTED", "REJECT"],
    "FLAGGED": ["FLAGGED", "FLAG", "EDIT"],
}
AREA_TOLERANCE_M2 = 10.0
SIDE_DEFAULTS = {"a": (95.0, 1), "b": (82.0, 2)}
PENDING = "pending_review"
AUTO_REVIEWER = "automated classifier"


def side_of(features: DataFrame, pairs: DataFrame, side: str) -> tuple[dict[str, str], list[str]]:
    """Names of a feature's key on one side of a pair, and the key columns that both tables have.

    Features are told apart by dataset and id wherever pairs carry the dataset.
    """
    names = {"feature_id": f"feature_{side}", "dataset_id": f"dataset_{side}"}
    return names, [k for c, k in names.items() if c in features.columns and k in pairs.columns]


def _best_first() -> list:
    return [F.desc("score"), F.asc("feature_a"), F.asc("feature_b")]


def simple_conflicts(matches: DataFrame) -> DataFrame:
    """Conflict type and severity from the match status alone; matched pairs have none."""
    missing = F.col("status") == "unmatched"
    return matches.where("status <> 'matched'").select(
        "feature_a",
        "feature_b",
        F.when(missing, "missing_feature").otherwise("attribute").alias("type"),
        F.when(missing, "high").otherwise("medium").alias("severity"),
    )


def detect_conflicts(matches: DataFrame, features: DataFrame, area_tol: float = AREA_TOLERANCE_M2) -> DataFrame:
    """Rule cascade: area difference, then boundary deviation, then missing counterpart.

    features: (feature_id, area) and dataset_id, which counts where matches carry dataset_a
    and dataset_b. The stable ``conflict_key`` does not move between runs.
    """
    rows = matches
    for side in "ab":
        names, keys = side_of(features, rows, side)
        areas = features.select(*[F.col(c).alias(k) for c, k in names.items() if k in keys], F.col("area").alias(f"area_{side}"))
        rows = rows.join(areas, keys, "left")
    datasets = [c for c in ("dataset_a", "dataset_b") if c in matches.columns]
    known = F.col("area_a").isNotNull() & F.col("area_b").isNotNull()
    rows = rows.withColumns({f"area_{s}": F.when(known, F.col(f"area_{s}")).otherwise(0.0) for s in "ab"})
    rows = rows.withColumn("area_difference", F.abs(F.col("area_a") - F.col("area_b")))
    by_area = F.col("area_difference") > area_tol
    deviates = (F.col("status") == "review") | ((F.col("score") < 90) & (F.col("score") >= 70))
    missing = (F.col("status") == "unmatched") | (F.col("score") < 70)

    def pick(area, geometry, absent) -> Column:
        return F.when(by_area, area).when(deviates, geometry).when(missing, absent)

    # The texts of the three reasons.
    reason = F.format_string(
        "Area discrepancy detected: %.1f m² vs %.1f m² (Delta: %.1f m²)", "area_a", "area_b", "area_difference"
    )
    rows = rows.withColumns(
        {
            "type": pick("area", "geometry", "missing_feature"),
            "severity": pick("medium", "medium", "high"),
            "reason": pick(
                reason,
                F.lit("Boundary geometry deviation detected between survey and municipal GIS"),
                F.lit("Feature missing or unaligned in municipal registry"),
            ),
        }
    )
    return rows.where("type is not null").select(
        F.xxhash64("feature_a", "feature_b", "type", *datasets).alias("conflict_key"),
        "feature_a",
        "feature_b",
        *datasets,
        "type",
        "severity",
        "reason",
        "area_a",
        "area_b",
        "area_difference",
        "score",
        "status",
    )


def number_conflicts(conflicts: DataFrame, start: int = 1) -> DataFrame:
    """Consecutive ids in match order, without a single-task window.

    Rows are range-partitioned and sorted; each row's id is its place in its partition
    plus the sizes of the partitions before it (one small row per partition).
    """
    ordered = conflicts.orderBy(*_best_first()).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    ordered = cut(ordered)
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return ordered.join(F.broadcast(offsets), "_part").select(
        (F.col("_offset") + F.col("_place") + start).alias("id"), *conflicts.columns
    )


def check_enums(conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows inside the contract, rejected rows with ``problem``)."""
    problem = (
        F.when(~F.coalesce(F.col("type").isin(*CONFLICT_TYPES), F.lit(False)), "unsupported conflict type")
        .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "unsupported severity")
        .when(~F.coalesce(F.col("id") >= 0, F.lit(False)), "conflict_id must be non-negative")
    )
    tagged = conflicts.withColumn("problem", problem)
    return tagged.where("problem is null").drop("problem"), tagged.where("problem is not null")


def _reliability(own, source) -> Column:
    value = F.coalesce(numeric_value(own), numeric_value(source))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(value, F.lit(100.0))))


def recommend(conflicts: DataFrame) -> DataFrame:
    """Engine action, confidence and reason for each conflict.

    Expects type, severity, score (nullable), rel_a, rel_b (nullable), has_a, has_b.
    """
    kind = F.col("type")
    a_more = F.coalesce(F.col("rel_a") > F.col("rel_b"), F.lit(False))
    b_more = F.coalesce(F.col("rel_b") > F.col("rel_a"), F.lit(False))
    only_a = (kind == "missing_feature") & F.col("has_a") & ~F.col("has_b")
    # Actions and reasons, in order of precedence.
    explicit = "Conflict type requires explicit review"
    rules = [
        (kind == "duplicate", "manual_review_required", explicit),
        (kind == "temporal", "flag_real_world_change", explicit),
        (a_more, "prefer_source_a", "Source A has the higher reliability score"),
        (b_more, "prefer_source_b", "Source B has the higher reliability score"),
        (kind.isin("attribute", "area"), "merge_attributes", "Both sources are available and the conflict is attribute-level"),
        (only_a, "prefer_source_a", "The feature is present only in source A"),
    ]

    def choose(at: int, default: str) -> Column:
        return F.coalesce(*[F.when(r[0], r[at]) for r in rules], F.lit(default))

    by_severity = reduce(
        lambda acc, s: acc.when(F.col("severity") == s[0], s[1]), CONFIDENCE.items(), F.when(F.lit(False), 0)
    )
    confidence = F.when(
        F.col("score").isNotNull(), F.greatest(F.lit(0), F.least(F.col("score").cast("int"), F.lit(100)))
    ).otherwise(by_severity)
    return conflicts.withColumns(
        {"action": choose(1, "manual_review_required"), "confidence": confidence, "reason": choose(2, explicit)}
    )


def bridge(recommendations: DataFrame) -> DataFrame:
    """Public contract: one ``prefer_source`` action plus ``preferred_dataset_id``."""
    a, b = F.col("action") == "prefer_source_a", F.col("action") == "prefer_source_b"
    return recommendations.withColumns(
        {
            "preferred_dataset_id": F.when(a, F.col("dataset_a")).when(b, F.col("dataset_b")),
            "preferred_side": F.when(a, "a").when(b, "b"),
            "action": F.when(a | b, "prefer_source").otherwise(F.col("action")),
        }
    )


def name_preferred(recommendations: DataFrame, datasets: DataFrame, sources: DataFrame) -> DataFrame:
    """Preferred source name through dataset to source; primary/secondary when unknown."""
    names = datasets.select(F.col("id").alias("preferred_dataset_id"), "source_id").join(
        sources.select("source_id", F.col("name").alias("_name")), "source_id", "left"
    )
    default = F.when(F.col("preferred_side") == "a", "Primary Source").when(
        F.col("preferred_side") == "b", "Secondary Source"
    )
    return (
        recommendations.join(names.drop("source_id"), "preferred_dataset_id", "left")
        .withColumn("preferred_source_name", F.coalesce("_name", default))
        .drop("_name")
    )


def attach_sides(conflicts: DataFrame, features: DataFrame) -> DataFrame:
    """Reliability, dataset and presence of both features; the side defaults where details are missing."""
    for s in "ab":
        rel, dataset = SIDE_DEFAULTS[s]
        _, keys = side_of(features, conflicts, s)
        side = features.select(
            F.col("feature_id").alias(f"feature_{s}"),
            F.col("dataset_id").cast("int").alias(f"dataset_{s}"),
            _reliability(F.col("source_reliability"), F.lit(None)).alias(f"rel_{s}"),
            F.lit(True).alias(f"has_{s}"),
        )
        conflicts = conflicts.join(side, keys, "left").withColumns(
            {
                f"rel_{s}": F.when(F.col(f"has_{s}").isNull(), F.lit(rel)).otherwise(F.col(f"rel_{s}")),
                f"dataset_{s}": F.coalesce(f"dataset_{s}", F.lit(dataset)),
                f"has_{s}": F.lit(True),
            }
        )
    return conflicts


def canonical_decision(decision) -> Column:
    upper = F.upper(F.trim(col(decision).cast("string")))
    out = F.when(F.lit(False), "")
    for name, aliases in DECISIONS.items():
        out = out.when(upper.isin(*aliases), name)
    return out.otherwise(upper)


def latest_reviews(reviews: DataFrame, key: str = "conflict_id") -> DataFrame:
    """Last review per conflict by time, then event id; one map-side-combined aggregate."""
    others = [c for c in reviews.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct("ts", "event_id"))
    return reviews.groupBy(key).agg(last.alias("_r")).select(key, "_r.*")


def overlay_reviews(conflicts: DataFrame, reviews: DataFrame, key: str = "conflict_id") -> DataFrame:
    """Review state of every conflict; ``pending_review`` where none was given."""
    last = latest_reviews(reviews, key).select(key, canonical_decision("decision").alias("_d"))
    return conflicts.join(last, key, "left").withColumn("status", F.coalesce("_d", F.lit(PENDING))).drop("_d")


def auto_approve(conflicts: DataFrame, threshold: int = 90) -> DataFrame:
    """Review rows approving every conflict at or above ``threshold`` that is not approved yet."""
    # Reviewer and comment of an automatic approval.
    return conflicts.where((F.col("score") >= threshold) & (F.col("status") != "APPROVED")).select(
        "conflict_id",
        F.lit("APPROVED").alias("decision"),
        F.lit(AUTO_REVIEWER).alias("reviewer"),
        F.lit(f"Auto-approved above confidence threshold {threshold}%").alias("comment"),
    )


def limit_per_dataset(features: DataFrame, n: int | None = None) -> DataFrame:
    """Fair share per dataset; unlimited unless ``n`` is given."""
    if n is None:
        return features
    w = Window.partitionBy("dataset_id").orderBy("feature_id")
    return features.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def dedupe_features(features: DataFrame, order: str) -> DataFrame:
    """First row per (dataset_id, feature_id); it is left out if its geometry is invalid.

    The first row decides, as a later valid one is a leftover of the same feature. Rows
    without a ``geom`` column are not judged.
    """
    others = [c for c in features.columns if c not in ("dataset_id", "feature_id")]
    first = F.min_by(F.struct(*others), F.col(order))
    rows = features.groupBy("dataset_id", "feature_id").agg(first.alias("_f")).select("dataset_id", "feature_id", "_f.*")
    return rows.where(F.coalesce(is_valid("geom"), F.lit(False))) if "geom" in others else rows


def match_sources(features: DataFrame) -> DataFrame:
    """All datasets by size, largest first, ties by id: (dataset_id, n, rank)."""
    counts = features.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.struct((-F.col("n")).alias("size"), "dataset_id"))


def source_pairs(features: DataFrame, **options) -> DataFrame:
    """Candidate pairs between every two datasets that overlap; A is of the larger one, ties by id.

    One spatial join of the layer with itself; ``rank`` orders the two sides of a pair and
    is compared in the join, so pairs of one dataset and mirrored ones are never formed.
    """
    ranked = cut(features.join(match_sources(features).select("dataset_id", "rank"), "dataset_id"))
    return candidates(ranked, ranked, rank="rank", **options)


def balanced_queue(cadastral: DataFrame, building: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs of both kinds, best first overall; ``n`` keeps the best of each kind for a report."""
    best = [df.withColumn("queue_kind", F.lit(kind)) for df, kind in ((cadastral, "cadastral"), (building, "building"))]
    if n is not None:
        best = [df.orderBy(*_best_first()).limit(n) for df in best]
    return best[0].unionByName(best[1]).orderBy(*_best_first())


def attach_details(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Both feature records as structs on every pair."""
    for s in "ab":
        names, keys = side_of(features, pairs, s)
        details = features.select(
            *[F.col(c).alias(k) for c, k in names.items() if k in keys], F.struct(*features.columns).alias(f"feature_{s}_details")
        )
        pairs = pairs.join(details, keys, "left")
    return pairs


def filter_matches(matches: DataFrame, band: str | None = None, query: str | None = None) -> DataFrame:
    """Band (high / review / low) and case-insensitive substring of either id or the owner."""
    bands = {
        "high": F.col("score") >= 90,
        "review": (F.col("score") >= 70) & (F.col("score") < 90),
        "low": F.col("score") < 70,
    }
    if band:
        matches = matches.where(bands[band])
    if query:
        needle = F.lit(query.lower())
        hit = F.lit(False)
        for c in ("feature_a", "feature_b", "owner"):
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
        matches = matches.where(hit)
    return matches


def impact(matches: DataFrame, summary: DataFrame) -> DataFrame:
    """Effect of a topology run on each feature_a: its last pair, score lift and new status.

    summary: one row with vertices_snapped, overlaps_resolved, gaps_resolved, slivers_cleaned.
    With dataset_a and dataset_b on the matches, they belong to the keys and to the result.
    """
    key, other = ([c for c in (f"dataset_{s}", f"feature_{s}") if c in matches.columns] for s in "ab")
    last = matches.groupBy(*key).agg(
        F.max_by(F.struct(*other, "score", "status"), F.struct(-F.col("score"), *reversed(other))).alias("m")
    )
    lift = (
        F.least(F.col("vertices_snapped"), F.lit(12)) * 0.4
        + F.col("overlaps_resolved") * 4.0
        + F.col("gaps_resolved") * 3.0
        + F.col("slivers_cleaned") * 2.0
    )
    fixes = F.col("vertices_snapped") + F.col("overlaps_resolved") + F.col("gaps_resolved")
    one_row = summary.limit(1).select(F.lit(1).alias("_k"), lift.alias("lift"), fixes.alias("fixes_applied"))
    rows = last.withColumn("_k", F.lit(1)).join(F.broadcast(one_row), "_k")
    after = F.least(F.lit(99.0), F.round(F.col("m.score") + F.col("lift"), 1))
    return rows.withColumn("score_after", after).select(
        *key,
        *[F.col(f"m.{c}").alias(c) for c in other],
        F.col("m.score").alias("score_before"),
        "score_after",
        F.col("m.status").alias("status_before"),
        F.when(F.col("score_after") >= 75, "matched").otherwise(F.col("m.status")).alias("status_after"),
        "fixes_applied",
    )

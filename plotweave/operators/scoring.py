"""Pair scoring: geometry, attribute and reliability evidence blended with the classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import col, with_stats
from plotweave.functions.text import normalize_texts, numeric_value, similarities
from plotweave.operators.model import predict_pairs
from plotweave.operators.spatial_join import candidates
from plotweave.session import cut

# Evidence weights, compared fields and cut-offs.
WEIGHTS = {
    "geometry": 0.25,
    "proximity": 0.20,
    "area": 0.15,
    "hausdorff": 0.15,
    "attributes": 0.15,
    "reliability": 0.10,
}
ATTRIBUTE_FIELDS = [
    "ulpin", "bhu_aadhar", "khasra_no", "land_use", "name", "address", "type", "category", "owner",
]
SAME_ATTRIBUTE = 0.85
MAX_DISTANCE = 0.01
MAX_HAUSDORFF = 0.005
DEFAULT_RELIABILITY = 0.80
HIGH = 90
REVIEW = 70


def _clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def classify(score, high: int = HIGH, review: int = REVIEW) -> Column:
    if not 0 <= review <= high <= 100:
        raise ValueError("matching thresholds must satisfy 0 <= review <= high <= 100")
    s = col(score)
    return F.when(s >= high, "matched").when(s >= review, "review").otherwise("unmatched")


def auto_partition(df: DataFrame, threshold: int = HIGH, review: int = REVIEW) -> DataFrame:
    """Add ``queue``; write the result with ``partitionBy("queue")`` to separate the queues."""
    queue = (
        F.when(F.col("score") >= threshold, "auto_approved")
        .when(F.col("score") >= review, "review_queue")
        .otherwise("unmatched")
    )
    return df.withColumn("queue", queue)


def iou(inter, area_a, area_b) -> Column:
    """Shared over joint area. Both empty of area: the caller's equality test decides."""
    union = col(area_a) + col(area_b) - col(inter)
    return F.when(union > 0, _clamp(col(inter) / union))


def proximity(ax, ay, bx, by, maximum: float = MAX_DISTANCE) -> Column:
    distance = F.hypot(col(bx) - col(ax), col(by) - col(ay))
    return F.coalesce(_clamp(1.0 - distance / F.lit(max(maximum, 1e-12))), F.lit(0.0))


def area_similarity(a, b) -> Column:
    a, b = col(a), col(b)
    return (
        F.when(a.isNull() | b.isNull() | (a < 0) | (b < 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(_clamp(F.least(a, b) / F.greatest(a, b)))
    )


def hausdorff_similarity(distance, maximum: float = MAX_HAUSDORFF) -> Column:
    return F.coalesce(_clamp(1.0 - col(distance) / F.lit(maximum)), F.lit(0.0))


def reliability(own, source=None) -> Column:
    """0..1 from a 0..100 score: the record's own, else its source's, else the default."""
    value = F.coalesce(numeric_value(own), numeric_value(source) if source is not None else F.lit(None))
    return F.coalesce(_clamp(value, 0.0, 100.0) / 100.0, F.lit(DEFAULT_RELIABILITY))


def attribute_evidence(sims) -> tuple[Column, Column, Column]:
    """(mean similarity, matched fields, differing fields) of a 0..100 similarity array."""
    pairs = F.zip_with(
        F.array(*[F.lit(f) for f in ATTRIBUTE_FIELDS]),
        col(sims),
        lambda f, s: F.struct(f.alias("field"), (s / 100.0).alias("sim")),
    )
    compared = F.filter(pairs, lambda p: p["sim"].isNotNull())
    mean = F.aggregate(compared, F.lit(0.0), lambda a, p: a + p["sim"]) / F.size(compared)

    def names(keep) -> Column:
        return F.transform(F.filter(compared, keep), lambda p: p["field"])

    return (
        F.when(F.size(compared) > 0, mean).otherwise(0.0),
        names(lambda p: p["sim"] >= SAME_ATTRIBUTE),
        names(lambda p: p["sim"] < SAME_ATTRIBUTE),
    )


def heuristic(components: dict[str, Column]) -> Column:
    """0..100 from components that are already rounded to 4 decimals."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * components[name]
    return total * 100.0


def prepare(layer: DataFrame) -> DataFrame:
    """One row per feature with what a pair needs, so text is folded once per feature, not per pair.

    Expects feature_id and geom; takes area, source_reliability, reliability_score and
    any compared attribute that is present.
    """
    have = set(layer.columns)

    def get(*names: str) -> Column:
        present = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*[F.when(p != "", p) for p in present]) if present else F.lit(None).cast("string")

    def or_null(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    texts = [F.col(f) if f in have else F.lit("") for f in ATTRIBUTE_FIELDS]
    folded = normalize_texts([*texts, get("khasra", "khasra_no", "plot_no")])
    n = len(ATTRIBUTE_FIELDS)
    layer = layer.withColumn("_texts", folded)
    return with_stats(
        layer.select(
            "feature_id",
            *(["dataset_id"] if "dataset_id" in have else []),
            "geom",
            or_null("area", "double").alias("area"),
            reliability(or_null("source_reliability", "string"), or_null("reliability_score", "string")).alias("rel"),
            F.slice("_texts", 1, n).alias("texts"),
            F.upper(F.trim(get("ulpin", "bhu_aadhar"))).alias("ulpin_key"),
            F.get("_texts", F.lit(n)).alias("khasra_key"),
        )
    )


def pair_rows(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Attach both prepared features to pairs, by dataset and feature id where the pairs carry both.

    In merge joins: by the size of its packed files, a layer with texts and shapes would be broadcast.
    """
    for df, p in ((a, "a"), (b, "b")):
        keys = {c: f"{c.removesuffix('_id')}_{p}" for c in ("feature_id", "dataset_id")}
        keys = {c: k for c, k in keys.items() if c in df.columns and k in pairs.columns}
        side = df.select(*[F.col(c).alias(keys.get(c, f"{p}_{c}")) for c in df.columns])
        pairs = pairs.join(side.hint("merge"), list(keys.values()))
    return pairs


def evidence(rows: DataFrame) -> DataFrame:
    """Add iou, prox, area_sim, haus, attrs, matched/differing fields, rel_a, rel_b (unrounded)."""
    # In one step, so that a pair goes to Python once.
    rows = rows.withColumns(
        {
            "_inter": k.intersection_area("a_geom", "b_geom"),
            "_haus": k.hausdorff("a_geom", "b_geom"),
            "_sims": similarities("a_texts", "b_texts"),
        }
    )
    mean, matched, differing = attribute_evidence("_sims")
    flat = F.coalesce((F.col("_haus") == 0).cast("double"), F.lit(0.0))
    have_both = F.col("a_geom").isNotNull() & F.col("b_geom").isNotNull()
    return rows.withColumns(
        {
            "iou": F.when(have_both, F.coalesce(iou("_inter", "a_area_deg2", "b_area_deg2"), flat)).otherwise(0.0),
            "prox": proximity("a_cx", "a_cy", "b_cx", "b_cy"),
            "area_sim": area_similarity("a_area", "b_area"),
            "haus": hausdorff_similarity("_haus"),
            "attrs": mean,
            "matched_attributes": matched,
            "differing_attributes": differing,
            "rel_a": F.col("a_rel"),
            "rel_b": F.col("b_rel"),
        }
    ).drop("_inter", "_haus", "_sims")


def components(df: DataFrame) -> DataFrame:
    """The six evidence components, rounded to 4 decimals, as c_<name>; and ``heuristic``."""
    parts = {
        "geometry": F.col("iou"),
        "proximity": F.col("prox"),
        "area": F.col("area_sim"),
        "hausdorff": F.col("haus"),
        "attributes": F.col("attrs"),
        "reliability": (F.col("rel_a") + F.col("rel_b")) / 2.0,
    }
    df = df.withColumns({f"c_{n}": F.round(v, 4) for n, v in parts.items()})
    return df.withColumn("heuristic", heuristic({n: F.col(f"c_{n}") for n in parts}))


def blend(df: DataFrame) -> DataFrame:
    """Final score and class from ``mlp_score``, ``mlp_class`` and ``heuristic`` plus the identifier rules."""
    nothing = F.lit(True)
    for name in ("iou", "prox", "area_sim", "haus", "attrs"):
        nothing = nothing & (F.col(name) == 0)
    blended = F.bround(0.6 * F.col("mlp_score") + 0.4 * F.col("heuristic"), 0)
    same_ulpin = F.coalesce(
        (F.col("a_ulpin_key") == F.col("b_ulpin_key")) & (F.length("a_ulpin_key") >= 11), F.lit(False)
    )
    same_khasra = F.coalesce(
        (F.col("a_khasra_key") == F.col("b_khasra_key")) & (F.col("a_khasra_key") != ""), F.lit(False)
    )
    df = df.withColumn("score", F.when(nothing, 0).otherwise(_clamp(blended, 0.0, 100.0)).cast("int"))
    df = df.withColumn("mlp_class", F.when(nothing, "unmatched").otherwise(F.col("mlp_class")))
    if "mlp_probabilities" in df.columns:
        none = F.struct(F.lit(1.0).alias("unmatched"), F.lit(0.0).alias("review"), F.lit(0.0).alias("matched"))
        df = df.withColumn("mlp_probabilities", F.when(nothing, none).otherwise(F.col("mlp_probabilities")))
    df = df.withColumn("score", F.when(same_ulpin, F.greatest("score", F.lit(98))).otherwise(F.col("score")))
    df = df.withColumn("mlp_class", F.when(same_ulpin, "matched").otherwise(F.col("mlp_class")))
    df = df.withColumn("score", F.when(same_khasra, F.greatest("score", F.lit(88))).otherwise(F.col("score")))
    by_score = F.when(F.col("score") >= HIGH, "matched").when(F.col("score") >= REVIEW, "review")
    return df.withColumn(
        "mlp_class", F.when(same_khasra, F.coalesce(by_score, F.col("mlp_class"))).otherwise(F.col("mlp_class"))
    ).withColumn("status", classify("score"))


def score(rows: DataFrame, model) -> DataFrame:
    """Scored pairs from :func:`pair_rows`."""
    return blend(components(predict_pairs(model, evidence(rows))))


RESULT = [
    "feature_a", "feature_b", "score", "status", "c_geometry", "c_proximity", "c_area", "c_hausdorff",
    "c_attributes", "c_reliability", "mlp_score", "mlp_class", "mlp_probabilities", "matched_attributes",
    "differing_attributes",
]


def match(a: DataFrame, b: DataFrame, model, cap: int | None = None, fallback: int = 0) -> DataFrame:
    """End to end: candidates, evidence, classifier, blend. All candidates unless ``cap`` is given. Order with :func:`ranked`."""
    a, b = cut(prepare(a)), cut(prepare(b))
    pairs = candidates(a, b, cap=cap, fallback=fallback)
    keys = [c for c in ("dataset_a", "dataset_b") if c in pairs.columns]
    return score(pair_rows(pairs, a, b), model).select(*RESULT, *keys)


def ranked(matches: DataFrame) -> DataFrame:
    """Best first, then by both ids."""
    return matches.orderBy(F.desc("score"), "feature_a", "feature_b")

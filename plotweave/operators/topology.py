"""Layer topology: snapping, overlaps, gaps, health and the correction run.

A layer has feature_id, idx (its order) and geom, plus any other columns. Stages of the
correction are cut from each other, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import GEOMETRY, area, bbox, deg2_to_m2, expand_bbox, is_empty, m2_to_deg2, n_vertices
from plotweave.operators.spatial_join import grid_join, overlay_pairs, overlapping
from plotweave.operators.union import gaps
from plotweave.session import cut, scratch_folder

# Default tolerances of the correction.
TOLERANCE = 0.00005
MIN_OVERLAP_M2 = 0.01
MIN_GAP_M2 = 0.001
MAX_GAP_M2 = 50.0
MAX_OVERLAP_M2 = 100.0
NOISE_M2 = 1e-6

FIX = ["fix_type", "idx", "feature_id", "description", "delta_area_sqm", "vertices_affected"]


def _fix(kind: str, description: Column, delta: Column, vertices: Column) -> list[Column]:
    return [
        F.lit(kind).alias("fix_type"),
        F.col("idx"),
        F.col("feature_id").cast("string").alias("feature_id"),
        description.alias("description"),
        delta.cast("double").alias("delta_area_sqm"),
        vertices.cast("long").alias("vertices_affected"),
    ]


def _vertices(layer: DataFrame) -> DataFrame:
    """One row per coordinate: idx, odd, part, ring, pos, x, y. ``odd`` geometries change when they are rebuilt as they are."""
    repeats = "exists(zip_with(r, slice(r, 2, size(r)), (p, q) -> coalesce(p = q, false)), e -> e)"
    plain = f"""geom.type = if(size(geom.parts) > 1, 'MultiPolygon', 'Polygon') and not exists(
        flatten(transform(geom.parts, p -> concat(array(p.shell), p.holes))), r -> size(r) < 4 or {repeats})"""
    odd = ~F.coalesce(F.expr(" ".join(plain.split())), F.lit(False))
    rows = layer.select("idx", odd.alias("odd"), F.posexplode("geom.parts").alias("part", "p"))
    rows = rows.select("idx", "odd", "part", F.posexplode(F.concat(F.array("p.shell"), F.col("p.holes"))).alias("ring", "r"))
    return rows.select("idx", "odd", "part", "ring", F.posexplode("r").alias("pos", "q")).select(
        "idx", "odd", "part", "ring", "pos", F.col("q.x").alias("x"), F.col("q.y").alias("y")
    )


def _rebuild(rows: DataFrame) -> DataFrame:
    """(idx, geom) from ordered coordinate rows (idx, part, ring, at, x, y)."""
    ring = rows.groupBy("idx", "part", "ring").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("c"))
    # Neighbouring equal points merge after snapping.
    spot = "named_struct('x', {0}.x, 'y', {0}.y)"
    slim = f"transform(filter(c, (v, i) -> i = 0 or {spot.format('v')} <> {spot.format('c[i - 1]')}), v -> {spot.format('v')})"
    ring = ring.select("idx", "part", "ring", F.expr(slim).alias("r")).where("size(r) > 3")
    parts = ring.groupBy("idx", "part").agg(F.sort_array(F.collect_list(F.struct("ring", "r"))).alias("rs"))
    parts = parts.where("rs[0].ring = 0").select(
        "idx",
        "part",
        F.struct(
            F.expr("rs[0].r").alias("shell"), F.expr("transform(slice(rs, 2, size(rs)), v -> v.r)").alias("holes")
        ).alias("p"),
    )
    whole = parts.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("part", "p"))).alias("ps"))
    kind = F.when(F.size("ps") > 1, "MultiPolygon").otherwise("Polygon")
    geom = F.struct(kind.alias("type"), F.expr("transform(ps, v -> v.p)").alias("parts")).cast(GEOMETRY)
    return whole.select("idx", geom.alias("geom"))


def _spot(x: str, y: str, pad: float = 0.0) -> Column:
    x, y = F.col(x), F.col(y)
    return F.struct((x - pad).alias("minx"), (y - pad).alias("miny"), (x + pad).alias("maxx"), (y + pad).alias("maxy"))


def _spots(verts: DataFrame) -> DataFrame:
    """Distinct places of vertices: rx, ry, rank and least (highest and lowest idx there), odd."""
    return verts.groupBy(F.col("x").alias("rx"), F.col("y").alias("ry")).agg(
        F.max("idx").alias("rank"), F.min("idx").alias("least"), F.bool_or("odd").alias("odd")
    )


def snap(layer: DataFrame, ref: DataFrame | None = None, tol: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Snap a polygon layer to the vertices of a reference layer, or to itself.

    Every vertex moves to the nearest reference vertex within ``tol``; reference vertices
    close to a remaining edge are inserted into it. Within a layer, a vertex moves to
    features that come after it, the last one in order first: the outcome of the
    pair-by-pair loop for separate pairs, in one pass. Vertices of all other features,
    where they lie after moving, are inserted into edges, so a T-junction closes in
    either order of its features. Returns (layer, fixes).
    """
    own = ref is None
    layer = cut(layer)
    verts = cut(_vertices(layer))
    spots = cut(_spots(verts))
    anchors = spots if own else cut(_spots(_vertices(ref)))
    anchors = anchors.select("rx", "ry", "rank", _spot("rx", "ry").alias("rbox"))

    d = F.hypot(F.col("rx") - F.col("x"), F.col("ry") - F.col("y"))
    later = lambda idx: F.col("rank") > F.col(idx) if own else F.lit(True)
    best = F.struct(-F.col("rank") if own else F.lit(0), d, F.col("rx"), F.col("ry"))
    key = ["idx", "part", "ring", "pos"]
    real = (F.col("rx") != F.col("x")) | (F.col("ry") != F.col("y")) | F.col("odd")
    # Vertices on one spot have the same neighbours, so spots meet once for all of them; those that meet only themselves are done.
    left = spots.select(F.col("rx").alias("x"), F.col("ry").alias("y"), "least", "odd", _spot("rx", "ry", tol).alias("lbox"))
    near = grid_join(left, anchors, ready=True).where((d <= tol) & later("least"))
    near = near.withColumn("_real", F.max(real).over(Window.partitionBy("x", "y"))).where("_real").select("x", "y", "rx", "ry", "rank")
    target = verts.join(near, ["x", "y"]).where(later("idx")).groupBy(*key).agg(
        F.min_by(F.struct("rx", "ry", real.alias("real")), best).alias("to")
    )
    target = target.where("to.real").select(*key, *[F.lit(None).cast("double").alias(n) for n in "xy"], "to.rx", "to.ry")
    # From here on rows meet by feature: they are dealt out once, by idx, and no aggregate, window or ring needs another shuffle.
    # Vertices and their targets are united, as a join on the whole key would be dealt out again.
    along = Window.partitionBy("idx", "part", "ring").orderBy("pos")
    united = verts.select(*key, "x", "y").unionByName(target, allowMissingColumns=True).repartition("idx")
    moved = united.groupBy(*key).agg(*[F.max(n).alias(n) for n in ("x", "y", "rx", "ry")]).select(
        *key, F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"), F.col("rx").isNotNull().alias("hit")
    )
    moved = cut(moved.withColumns({"x2": F.lead("x").over(along), "y2": F.lead("y").over(along)}))
    edges = moved.drop("hit").where("x2 is not null and (x <> x2 or y <> y2)")
    box = F.struct(
        (F.least("x", "x2") - tol).alias("minx"),
        (F.least("y", "y2") - tol).alias("miny"),
        (F.greatest("x", "x2") + tol).alias("maxx"),
        (F.greatest("y", "y2") + tol).alias("maxy"),
    )
    ex, ey = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    length2 = ex * ex + ey * ey
    t = ((F.col("rx") - F.col("x")) * ex + (F.col("ry") - F.col("y")) * ey) / length2
    off = F.abs((F.col("rx") - F.col("x")) * ey - (F.col("ry") - F.col("y")) * ex) / F.sqrt(length2)
    if own:
        anchors = moved.groupBy(F.col("x").alias("rx"), F.col("y").alias("ry")).agg(
            F.max("idx").alias("rank"), F.min("idx").alias("least")
        )
        anchors = anchors.withColumn("rbox", _spot("rx", "ry"))
    others = (F.col("rank") != F.col("idx")) | (F.col("least") != F.col("idx")) if own else F.lit(True)
    beside = grid_join(edges.withColumn("lbox", box), anchors, ready="left" if own else True)
    beside = beside.where(others & (off <= tol) & (t > 0) & (t < 1))
    inserted = beside.select(*key, F.col("rx").alias("x"), F.col("ry").alias("y"), F.lit(True).alias("hit"), t.alias("t"), off.alias("off"))
    kept = moved.select(*key, "x", "y", "hit", F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("off"))
    # A vertex is inserted once, into the nearest edge, and not where the feature has a corner: corners have no ``off`` and come first.
    at_spot = Window.partitionBy("idx", "x", "y").orderBy(F.asc_nulls_first("off"), "part", "ring", "pos")
    # Features that nothing touches leave before the long sort, those whose insertions all fall on corners after it.
    touched = lambda rows: rows.withColumn("_hit", F.max("hit").over(Window.partitionBy("idx"))).where("_hit")
    rows = touched(kept.unionByName(inserted).repartition("idx")).withColumn("_n", F.row_number().over(at_spot))
    rows = touched(rows.where("off is null or _n = 1"))
    rebuilt = _rebuild(rows.select("idx", "part", "ring", F.struct("pos", "t").alias("at"), "x", "y"))
    rebuilt = rebuilt.withColumnRenamed("geom", "_new")
    joined = layer.join(rebuilt, "idx", "left").withColumn("_new", F.coalesce("_new", "geom"))
    joined = joined.withColumn("_ok", k.is_valid("_new"))
    joined = joined.withColumn("_fixed", k.make_valid(F.when(~F.col("_ok"), F.col("_new"))))
    joined = cut(joined.withColumn("_new", F.when(F.col("_ok"), F.col("_new")).otherwise(F.coalesce("_fixed", "geom"))))
    changed = joined.where("_new <> geom")
    # The text of the ledger row.
    text = "Intra-layer vertex snap with neighboring polygons" if own else f"Snapped vertices to reference layer (tolerance={tol:.6f})"
    delta = F.round(deg2_to_m2(F.abs(area("_new") - area("geom"))), 4)
    fixes = changed.select(
        *_fix("snap", F.lit(text), delta, F.greatest(F.lit(1), F.abs(n_vertices("_new") - n_vertices("geom"))))
    )
    return joined.withColumn("geom", F.col("_new")).drop("_new", "_ok", "_fixed"), fixes


def detect_overlaps(layer: DataFrame, min_m2: float = MIN_OVERLAP_M2, outline: bool = False) -> DataFrame:
    """Overlapping pairs (idx_a < idx_b) with the shared area, 4 decimals."""
    pairs = overlapping(layer).withColumn("_m2", deg2_to_m2("overlap_units")).where(F.col("_m2") >= min_m2)
    extra = [k.clip("geom_a", "geom_b").alias("geom")] if outline else []
    return pairs.select(
        "idx_a", "idx_b", "feature_a", "feature_b", F.round("_m2", 4).alias("overlap_area_sqm"), *extra
    )


def detect_gaps(layer: DataFrame, max_m2: float = MAX_GAP_M2) -> DataFrame:
    """Small holes of the layer's union: (gap, gap_area_sqm, geom)."""
    usable = layer.where(~is_empty("geom")).where(k.is_valid("geom"))
    whole = usable.select(F.lit(0).alias("_all"), "geom")
    found = gaps(whole, "_all", m2_to_deg2(F.lit(MIN_GAP_M2)), m2_to_deg2(F.lit(max_m2)))
    return found.select("gap", F.round(deg2_to_m2("area_units"), 4).alias("gap_area_sqm"), "geom")


def _shapes(layer: DataFrame) -> DataFrame:
    """Distinct shapes under their first member: hash, idx, feature_id, geom, n. Outlines meet by a hash first, as they sort slowly."""
    shapes = layer.groupBy(F.xxhash64("geom").alias("hash"), "geom").agg(
        F.min(F.struct("idx", "feature_id")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    return shapes.select("hash", "first.idx", "first.feature_id", "geom", "n")


def _members(layer: DataFrame, shapes: DataFrame) -> DataFrame:
    """The layer with ``shape``, the first feature of the same shape."""
    repeated = shapes.where("n > 1").select("hash", "geom", F.col("idx").alias("_shape"))
    members = layer.withColumn("hash", F.xxhash64("geom")).join(repeated, ["hash", "geom"], "left")
    return members.withColumn("shape", F.coalesce("_shape", "idx"))


def resolve_overlaps(layer: DataFrame, max_m2: float = MAX_OVERLAP_M2) -> tuple[DataFrame, DataFrame]:
    """Clip the later feature of every overlap up to ``max_m2`` in one pass over the given shapes. Returns (layer, fixes).

    For layers whose overlaps are separate; where three features share a piece, ``resolve_overlaps_in_order``
    is the pair-by-pair loop. Works on distinct shapes: a heap of copies enters the join once, under its earliest
    member, and every later feature loses the shared piece once, with one ledger row. Copies of one shape never clip each other (nothing would
    be left).
    """
    layer = cut(layer)
    shapes = cut(_shapes(layer))
    pairs = overlapping(shapes).withColumn("_m2", deg2_to_m2("overlap_units"))
    pairs = cut(
        pairs.where((F.col("_m2") > NOISE_M2) & (F.col("_m2") <= max_m2))
        .withColumn("piece", k.clip("geom_a", "geom_b"))
        .where("piece is not null")
        .select("idx_a", "idx_b", "feature_a", "feature_b", "piece", "_m2")
    )
    both = [
        pairs.select(
            F.col(f"idx_{x}").alias("anchor"), F.col(f"feature_{x}").alias("anchor_id"), F.col(f"idx_{y}").alias("shape"), "piece", "_m2"
        )
        for x, y in ("ab", "ba")
    ]
    members = _members(layer, shapes).select("idx", "feature_id", "shape")
    lost = both[0].unionByName(both[1]).join(members, "shape").where("idx > anchor")
    pieces = lost.groupBy("idx").agg(F.flatten(F.collect_set("piece.parts")).alias("parts"))
    cover = F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts")).cast(GEOMETRY)
    clipped = layer.join(pieces.select("idx", cover.alias("_cover")), "idx").withColumn(
        "_new", k.subtract("geom", "_cover")
    )
    new = cut(clipped.where("_new is not null").select("idx", "_new"))
    result = layer.join(new, "idx", "left").withColumn("geom", F.coalesce("_new", "geom")).drop("_new")
    # The text of the ledger row.
    text = F.concat(F.format_string("Clipped %.2f m² overlap with feature ", "_m2"), F.col("anchor_id"))
    fixes = lost.join(new.select("idx"), "idx", "left_semi").select(
        *_fix("overlap_merge", text, F.round("_m2", 4), F.lit(0))
    )
    return result, fixes


def _turns(layer: DataFrame, shapes: DataFrame) -> DataFrame:
    """(anchor, anchor_id, idx, box): which feature may clip which later one, and where at most.

    Distinct shapes are joined. A heap of copies clips through its first member, whose piece the
    later ones would only repeat; each of its members is clipped on its own.
    """
    met = overlapping(shapes).where(deg2_to_m2("overlap_units") > NOISE_M2)
    box = F.struct(
        F.greatest("ba.minx", "bb.minx").alias("minx"), F.greatest("ba.miny", "bb.miny").alias("miny"),
        F.least("ba.maxx", "bb.maxx").alias("maxx"), F.least("ba.maxy", "bb.maxy").alias("maxy"),
    )
    met = met.withColumns({"ba": bbox("geom_a"), "bb": bbox("geom_b")})
    pairs = cut(met.select("idx_a", "idx_b", "feature_a", "feature_b", box.alias("box")))
    both = [
        pairs.select(F.col(f"idx_{x}").alias("anchor"), F.col(f"feature_{x}").alias("anchor_id"), F.col(f"idx_{y}").alias("shape"), "box")
        for x, y in ("ab", "ba")
    ]
    members = _members(layer, shapes).select("idx", "shape")
    return both[0].unionByName(both[1]).join(members, "shape").where("idx > anchor").drop("shape")


def _waits(turns: DataFrame) -> DataFrame:
    """(before_anchor, before_idx, anchor, idx): turns that an earlier turn may change.

    That needs a feature in common that the earlier turn clips, and boxes that meet: what is cut
    off elsewhere does not matter.
    """
    first = turns.select(
        F.col("anchor").alias("before_anchor"), F.col("idx").alias("before_idx"), F.col("idx").alias("shared"), F.col("box").alias("lbox")
    )
    second = turns.select("anchor", "idx", F.explode(F.array("anchor", "idx")).alias("shared"), F.col("box").alias("rbox"))
    met = grid_join(first, second, keys=("shared",)).where("before_anchor < anchor")
    return met.select("before_anchor", "before_idx", "anchor", "idx")


def resolve_overlaps_in_order(layer: DataFrame, max_m2: float = MAX_OVERLAP_M2) -> tuple[DataFrame, DataFrame]:
    """Clip the later feature of every overlap up to ``max_m2``, pair by pair in the layer's order. Returns (layer, fixes).

    The outcome is that of a loop over all pairs (lower idx, higher idx) that clips shapes already
    clipped: a piece that one feature has lost is not taken from the next one again, an overlap
    that shrinks below the limit is resolved, and a clip that would leave nothing is left out. Pairs
    run in rounds: one is due when no earlier pair that touches it is open. Layers whose overlaps are separate need
    one round, others as many as their longest chain of touching overlaps.
    """
    layer = cut(layer)
    spark = layer.sparkSession
    shapes = cut(_shapes(layer))
    turns = cut(_turns(layer, shapes))
    waits = cut(_waits(turns))
    pair, folder, turn, kept = ["anchor", "idx"], f"{scratch_folder(spark)}/{uuid.uuid4().hex}", 0, {}
    part_of = lambda rows: rows.select(F.explode(F.array(*pair)).alias("idx")).distinct()
    now = cut(layer.select("idx", "geom").join(part_of(turns), "idx", "left_semi"))
    while True:
        due = cut(turns.join(waits.select(*pair).distinct(), pair, "left_anti"))
        met = due.join(now.select(F.col("idx").alias("anchor"), F.col("geom").alias("geom_a")), "anchor").join(now, "idx")
        met = met.withColumn("_m2", deg2_to_m2(k.intersection_area("geom_a", "geom")))
        met = met.where((F.col("_m2") > NOISE_M2) & (F.col("_m2") <= max_m2)).withColumn("piece", k.clip("geom_a", "geom"))
        met = cut(met.where("piece is not null").select("anchor", "anchor_id", "idx", "_m2", "piece"))
        pieces = met.groupBy("idx").agg(
            F.flatten(F.collect_list("piece.parts")).alias("parts"), F.min("anchor").alias("least"), F.count(F.lit(1)).alias("n")
        )
        cover = F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts")).cast(GEOMETRY)
        tried = cut(pieces.join(now, "idx").select("idx", "least", "n", k.subtract("geom", cover).alias("_new")))
        new = tried.where("_new is not null").select("idx", F.col("_new").alias("geom"))
        # Pieces that only together leave nothing take turns, the first one now.
        crowded = tried.where("_new is null and n > 1").select("idx", "least")
        later = due.select(*pair).where("false")
        if not crowded.isEmpty():
            crowd = met.join(crowded, "idx")
            later = cut(crowd.where("anchor > least").select(*pair))
            alone = crowd.where("anchor = least").join(now, "idx").select("idx", k.subtract("geom", "piece").alias("geom"))
            new = cut(new.unionByName(alone.where("geom is not null")))
            met = met.join(later, pair, "left_anti")
        # The text of the ledger row.
        text = F.concat(F.format_string("Clipped %.2f m² overlap with feature ", "_m2"), F.col("anchor_id"))
        fixes = met.join(new.select("idx"), "idx", "left_semi").join(layer.select("idx", "feature_id"), "idx").select(
            *_fix("overlap_merge", text, F.round("_m2", 4), F.lit(0))
        )
        for name, rows in (("clipped", new), ("fixes", fixes)):
            rows.write.parquet(f"{folder}/{name}/turn={turn}")
            kept[name] = rows.schema
        turn += 1
        held = due.join(later, pair, "left_semi")
        over = due.select(*pair).join(later, pair, "left_anti")
        turns = cut(turns.join(due.select(*pair), pair, "left_anti").unionByName(held))
        if turns.isEmpty():
            break
        waits = cut(waits.join(over.toDF("before_anchor", "before_idx"), ["before_anchor", "before_idx"], "left_anti"))
        now = cut(
            now.join(part_of(turns), "idx", "left_semi").join(new.withColumnRenamed("geom", "_new"), "idx", "left")
            .select("idx", F.coalesce("_new", "geom").alias("geom"))
        )
    read = lambda name: spark.read.schema(kept[name].add("turn", "integer")).parquet(f"{folder}/{name}")
    last = read("clipped").groupBy("idx").agg(F.max_by("geom", "turn").alias("_new"))
    result = layer.join(last, "idx", "left").withColumn("geom", F.coalesce("_new", "geom")).drop("_new")
    return result, read("fixes").drop("turn")


def best_contacts(layer: DataFrame, found: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """For each gap the feature with the longest contact, lowest idx on ties: (gap, idx, feature_id)."""
    gap_side = found.select(F.col("gap").alias("feature_id"), "geom")
    pairs = overlay_pairs(gap_side, layer, pad=tol)
    pairs = pairs.withColumns({"contact": k.contact_length("geom_b", "geom_a"), "apart": k.distance("geom_a", "geom_b")})
    pairs = pairs.where(F.col("apart") <= tol)
    best = pairs.groupBy(F.col("feature_a").alias("gap")).agg(
        F.min_by(F.struct(F.col("idx_b").alias("idx"), F.col("feature_b").alias("feature_id")), F.struct(-F.round("contact", 12), "idx_b")).alias("b")
    )
    return best.select("gap", "b.idx", "b.feature_id")


def resolve_gaps(
    layer: DataFrame, max_m2: float = MAX_GAP_M2, tol: float = TOLERANCE, found: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Give every small gap to the feature with the longest contact. Returns (layer, fixes)."""
    layer = cut(layer)
    found = cut(detect_gaps(layer, max_m2) if found is None else found)
    owner = cut(best_contacts(layer, found, tol))
    filled = owner.join(found, "gap")
    cover = filled.groupBy("idx").agg(F.flatten(F.collect_list("geom.parts")).alias("parts"))
    cover = cover.select(
        "idx", F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts")).cast(GEOMETRY).alias("_cover")
    )
    grown = layer.join(cover, "idx").select("idx", k.join_outline("geom", "_cover").alias("_new"))
    result = layer.join(grown, "idx", "left").withColumn("geom", F.coalesce("_new", "geom")).drop("_new")
    # The text of the ledger row.
    text = F.format_string("Absorbed %.2f m² vacant sliver gap", "gap_area_sqm")
    fixes = filled.drop("geom").select(*_fix("gap_fill", text, F.col("gap_area_sqm"), F.lit(0)))
    return result, fixes


def health(features, invalid, overlaps, overlap_m2, gap_count, gap_m2) -> Column:
    """Score 0..100: 30 for invalid features, up to 40 for overlaps, up to 30 for gaps."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (features, invalid, overlaps, overlap_m2, gap_count, gap_m2)]
    n, bad, ov, ov_m2, gp, gp_m2 = (c.cast("double") for c in cols)
    penalty = (
        bad / F.greatest(F.lit(1.0), n) * 30.0
        + F.least(F.lit(40.0), ov * 10.0 + ov_m2 / 100.0 * 10.0)
        + F.least(F.lit(30.0), gp * 10.0 + gp_m2 / 100.0 * 10.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100.0 - penalty, 1)))


def audit(layer: DataFrame, overlaps: DataFrame, found: DataFrame) -> DataFrame:
    """One row: features, invalid, overlaps, overlap_m2, gaps, gap_m2."""
    bad = is_empty("geom") | ~F.coalesce(k.is_valid("geom"), F.lit(False))
    parts = [
        layer.select(bad.alias("bad")).agg(F.count(F.lit(1)).alias("features"), F.count_if("bad").alias("invalid")),
        overlaps.agg(F.count(F.lit(1)).alias("overlaps"), F.coalesce(F.sum("overlap_area_sqm"), F.lit(0.0)).alias("overlap_m2")),
        found.agg(F.count(F.lit(1)).alias("gaps"), F.coalesce(F.sum("gap_area_sqm"), F.lit(0.0)).alias("gap_m2")),
    ]
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def repair_layer(layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invalid geometry made valid: (layer, ledger rows)."""
    invalid = ~is_empty("geom") & ~F.coalesce(k.is_valid("geom"), F.lit(False))
    judged = layer.withColumn("_bad", invalid)
    judged = cut(judged.withColumn("_fixed", k.make_valid(F.when(F.col("_bad"), F.col("geom")))))
    # The text of the ledger row.
    fixes = judged.where("_bad").select(
        *_fix("make_valid", F.lit("Repaired self-intersection / invalid ring via make_valid"), F.lit(0.0), F.lit(0))
    )
    now = judged.withColumn("geom", F.when(F.col("_bad"), F.col("_fixed")).otherwise(F.col("geom")))
    return now.drop("_bad", "_fixed"), fixes


def fix_topology(
    layer: DataFrame,
    ref: DataFrame | None = None,
    tol: float = TOLERANCE,
    max_gap_m2: float = MAX_GAP_M2,
    max_overlap_m2: float = MAX_OVERLAP_M2,
    merge_overlaps: bool = True,
    fill_gaps: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Make valid, snap, resolve overlaps and gaps. Returns (corrected layer, fixes)."""
    now, fixes = repair_layer(layer)
    for target in [None] if ref is None else [ref, None]:
        now, more = snap(now, target, tol)
        fixes = fixes.unionByName(more)
    if merge_overlaps:
        now, more = resolve_overlaps_in_order(now, max_overlap_m2)
        fixes = fixes.unionByName(more)
    if fill_gaps:
        now, more = resolve_gaps(now, max_gap_m2, tol)
        fixes = fixes.unionByName(more)
    return now, fixes


def correct_topology(
    layer: DataFrame,
    ref: DataFrame | None = None,
    tol: float = TOLERANCE,
    max_gap_m2: float = MAX_GAP_M2,
    max_overlap_m2: float = MAX_OVERLAP_M2,
    merge_overlaps: bool = True,
    fill_gaps: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Audit, make valid, snap, resolve overlaps and gaps, audit again.

    Returns (corrected layer, one-row summary, fixes, remaining issues). Where only the layer or
    its ledger is wanted, ``fix_topology`` is the run without the two audits.
    """
    layer = cut(layer)
    pre_overlaps, pre_gaps = cut(detect_overlaps(layer)), cut(detect_gaps(layer, max_gap_m2))
    before = audit(layer, pre_overlaps, pre_gaps)

    now, fixes = fix_topology(layer, ref, tol, max_gap_m2, max_overlap_m2, merge_overlaps, fill_gaps)
    now, fixes = cut(now), cut(fixes)

    left_overlaps, left_gaps = cut(detect_overlaps(now)), cut(detect_gaps(now, max_gap_m2))
    after = audit(now, left_overlaps, left_gaps)
    issues = left_overlaps.select(
        F.lit("overlap").alias("type"),
        F.concat(F.lit("Remaining overlap between "), "feature_a", F.lit(" and "), "feature_b").alias("description"),
        F.col("overlap_area_sqm").alias("area_sqm"),
    ).unionByName(
        left_gaps.select(
            F.lit("gap").alias("type"),
            F.concat(F.lit("Remaining vacant sliver hole of "), F.col("gap_area_sqm").cast("string"), F.lit(" m²")).alias("description"),
            F.col("gap_area_sqm").alias("area_sqm"),
        )
    )
    return now, summarize(before, after, fixes), fixes, issues


def summarize(before: DataFrame, after: DataFrame, fixes: DataFrame) -> DataFrame:
    """Counters, areas, health before and after, and the overall status, as one row."""
    kind = F.col("fix_type")
    done = fixes.agg(
        F.count_if(kind == "overlap_merge").alias("overlaps_resolved"),
        F.count_if(kind == "gap_fill").alias("gaps_resolved"),
        F.coalesce(F.sum(F.when(kind == "snap", F.col("vertices_affected"))), F.lit(0)).alias("vertices_snapped"),
        F.count_if(kind.isin("gap_fill", "overlap_merge")).alias("slivers_cleaned"),
        F.count(F.lit(1)).alias("fix_count"),
    )
    names = ["features", "invalid", "overlaps", "overlap_m2", "gaps", "gap_m2"]
    tagged = before.select(*[F.col(n).alias(f"b_{n}") for n in names]).unionByName(
        after.select(*[F.col(n).alias(f"a_{n}") for n in names]), allowMissingColumns=True
    ).unionByName(done, allowMissingColumns=True)
    row = tagged.agg(*[F.max(c).alias(c) for c in tagged.columns])
    clean = (F.col("a_invalid") == 0) & (F.col("a_overlaps") == 0) & (F.col("a_gaps") == 0)
    status = F.when(clean, "clean").when(F.col("fix_count") > 0, "corrected").otherwise("issues_remaining")
    return row.select(
        status.alias("status"),
        F.col("b_features").alias("total_features"),
        (F.col("b_features") - F.col("a_invalid")).alias("valid_features"),
        F.col("a_invalid").alias("invalid_features"),
        F.col("b_overlaps").alias("overlaps_detected"),
        "overlaps_resolved",
        F.col("b_gaps").alias("gaps_detected"),
        "gaps_resolved",
        "vertices_snapped",
        "slivers_cleaned",
        F.round("a_overlap_m2", 4).alias("total_overlap_area_sqm"),
        F.round("a_gap_m2", 4).alias("total_gap_area_sqm"),
        health(*[f"b_{n}" for n in names]).alias("initial_health_score"),
        health("b_features", *[f"a_{n}" for n in names[1:]]).alias("final_health_score"),
    )


def topology_health(layer: DataFrame, ref: DataFrame | None = None, tol: float = TOLERANCE) -> DataFrame:
    """Health summary without resolving overlaps or gaps; nothing is written."""
    return correct_topology(layer, ref, tol, merge_overlaps=False, fill_gaps=False)[1]


def snap_buildings(buildings: DataFrame, boundary: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Buildings snapped to the corrected parcels, flagged as predicted boundaries."""
    snapped, _ = snap(buildings, boundary, tol)
    return snapped.withColumn("snapped", F.lit(True)).withColumn("reconciled_status", F.lit("ai_predicted_optimal"))

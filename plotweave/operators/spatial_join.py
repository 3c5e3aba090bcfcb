"""Joins on location.

Boxes meet through an equi-join on grid cells. The grid has several levels, each cell
four times as wide as on the level below, and every feature lives on the level whose
cell is just larger than itself. A feature therefore owns at most four cells whatever
its size, and one huge feature does not fan out into thousands of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import GEOMETRY, bbox, expand_bbox, part
from plotweave.session import cut

MIN_CELL = 0.0005
GROWTH = 4
CANDIDATE_PAD = 0.0002


def _level(box: Column, cell: float) -> Column:
    extent = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    steps = F.ceil(F.log(float(GROWTH), extent / F.lit(cell)) - 1e-9)
    return F.when(extent <= cell, F.lit(0)).otherwise(steps).cast("int")


def _size(level: Column, cell: float) -> Column:
    return F.pow(F.lit(float(GROWTH)), level) * F.lit(cell)


def _in_cells(df: DataFrame, box: str, level: Column, cell: float) -> DataFrame:
    """One row per cell that the box covers on the given level."""
    df = df.withColumn("_level", level).where(F.col(f"{box}.minx").isNotNull())
    size = _size(F.col("_level"), cell)
    for axis, low, high in (("_cx", "minx", "maxx"), ("_cy", "miny", "maxy")):
        first, last = F.floor(F.col(f"{box}.{low}") / size), F.floor(F.col(f"{box}.{high}") / size)
        df = df.withColumn(axis, F.explode(F.sequence(first, last)))
    return df


def _levels(left: DataFrame, right: DataFrame, cell: float) -> tuple[list[int], list[int]]:
    """Grid levels present on each side: a few integers, one row per level."""
    seen = (
        left.select(F.lit(0).alias("side"), _level(F.col("lbox"), cell).alias("level"))
        .unionByName(right.select(F.lit(1).alias("side"), _level(F.col("rbox"), cell).alias("level")))
        .where("level is not null")
        .distinct()
        .collect()
    )
    return tuple(sorted(r["level"] for r in seen if r["side"] == side) for side in (0, 1))


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: tuple[str, ...] = (),
    cell: float = MIN_CELL,
    levels: tuple[list[int], list[int]] | None = None,
    ready: bool | str = False,
) -> DataFrame:
    """Pairs whose boxes ``lbox`` and ``rbox`` meet, each exactly once.

    ``keys`` are equality columns present on both sides. A pair is produced on the level
    of its larger member, in the one cell that holds the upper of the two lower corners,
    so no distinct is needed afterwards. Both sides are materialized first: they are
    read twice, and boxes of long polygons are costly to recompute. Pass ``ready`` when
    they already are cheap projections of stored tables, ``"left"`` or ``"right"`` if one is.
    A cell that holds very many boxes is a skewed key; Spark splits its partition and repeats
    the other side's.
    """
    if ready in (False, "right"):
        left = cut(left)
    if ready in (False, "left"):
        right = cut(right)
    left_levels, right_levels = levels or _levels(left, right, cell)
    on = [*keys, "_level", "_cx", "_cy"]

    def meet(owner: DataFrame, owner_box: str, guest: DataFrame, guest_box: str, present: list[int], lowest: int):
        own = _in_cells(owner, owner_box, _level(F.col(owner_box), cell), cell)
        reach = F.filter(
            F.array(*[F.lit(v) for v in present]), lambda v: v >= _level(F.col(guest_box), cell) + lowest
        )
        visits = _in_cells(guest.withColumn("_reach", reach), guest_box, F.explode("_reach"), cell).drop("_reach")
        size = _size(F.col("_level"), cell)
        l, r = F.col("lbox"), F.col("rbox")
        first = lambda axis: F.floor(F.greatest(l[axis], r[axis]) / size)
        return (
            own.join(visits, on)
            .where((l["minx"] <= r["maxx"]) & (r["minx"] <= l["maxx"]))
            .where((l["miny"] <= r["maxy"]) & (r["miny"] <= l["maxy"]))
            .where((F.col("_cx") == first("minx")) & (F.col("_cy") == first("miny")))
            .drop("_level", "_cx", "_cy")
        )

    columns = [*keys, *[c for c in left.columns + right.columns if c not in keys]]
    pairs = meet(left, "lbox", right, "rbox", left_levels or [0], 0)
    if right_levels and left_levels and max(right_levels) > min(left_levels):
        larger = meet(right, "rbox", left, "lbox", right_levels, 1)
        return pairs.select(columns).unionByName(larger.select(columns))
    return pairs.select(columns)


def _ids(df: DataFrame, side: str) -> list[Column]:
    """feature_id, and dataset_id if the layer has one, under a side suffix: together they name a feature."""
    return [F.col(c).alias(f"{c.removesuffix('_id')}_{side}") for c in ("feature_id", "dataset_id") if c in df.columns]


def candidates(
    a: DataFrame, b: DataFrame, pad: float = CANDIDATE_PAD, cap: int | None = None, fallback: int = 0, rank: str | None = None
) -> DataFrame:
    """Candidate pairs (feature_a, feature_b, distance, fallback) between two layers.

    Layers carry feature_id, minx..maxy, cx, cy; with dataset_id on a layer, pairs carry
    dataset_a or dataset_b as well. Boxes of A grown by ``pad`` meet boxes of B. All
    pairs are given unless ``cap`` asks for the nearest per A, ties by id; copies of one
    shape in B are then cut to the first ``cap`` before the join, as no A can keep more of
    them. ``fallback`` pairs an A without any partner with so many first features of B.
    ``rank`` names a column of both layers; only pairs whose A ranks lower than B are formed.
    """
    box = F.struct("minx", "miny", "maxx", "maxy")
    right = b.where("minx is not null").select(
        *_ids(b, "b"), *([F.col(rank).alias("_rank_b")] if rank else []), box.alias("rbox"), F.col("cx").alias("bx"), F.col("cy").alias("by")
    )
    if cap is not None:
        same_shape = Window.partitionBy("rbox", "bx", "by", *(["_rank_b"] if rank else [])).orderBy("feature_b")
        right = right.withColumn("_n", F.row_number().over(same_shape)).where(F.col("_n") <= cap).drop("_n")
    left = a.where("minx is not null").select(
        *_ids(a, "a"),
        *([F.col(rank).alias("_rank_a")] if rank else []),
        expand_bbox(box, pad).alias("lbox"),
        F.col("cx").alias("ax"),
        F.col("cy").alias("ay"),
    )
    ids = [c for c in (*left.columns, *right.columns) if c.startswith(("feature_", "dataset_"))]
    met = grid_join(left, right)
    met = met.where("_rank_a < _rank_b") if rank else met
    near = met.select(*ids, F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("distance"))
    if cap is not None:
        order = Window.partitionBy(*[c for c in ids if c.endswith("_a")]).orderBy("distance", "feature_b")
        near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    near = near.withColumn("fallback", F.lit(False))
    if not fallback:
        return near
    near = cut(near)  # read twice: as the result and to see who is alone
    return near.unionByName(_fallback(a, b, near, fallback))


def _fallback(a: DataFrame, b: DataFrame, near: DataFrame, n: int) -> DataFrame:
    """A without partner x the first n of B; the B side is n rows by construction."""
    first = (
        b.select(*_ids(b, "b"))
        .orderBy("feature_b")
        .limit(n)
        .withColumn("_slot", F.row_number().over(Window.orderBy("feature_b")))
    )
    names = a.select(*_ids(a, "a"))
    alone = names.join(near.select(*names.columns), names.columns, "left_anti")
    slots = alone.withColumn("_slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return slots.join(F.broadcast(first), "_slot").drop("_slot").withColumns(
        {"distance": F.lit(None).cast("double"), "fallback": F.lit(True)}
    )


def _boxed(df: DataFrame, prefix: str, pad: float = 0.0) -> DataFrame:
    """id, idx and geometry under a side prefix, with the box column grid_join expects."""
    side = "l" if prefix == "a" else "r"
    extra = [F.col("idx").alias(f"idx_{prefix}")] if "idx" in df.columns else []
    box = bbox("geom") if not pad else expand_bbox(bbox("geom"), pad)
    return df.select(
        F.col("feature_id").alias(f"feature_{prefix}"),
        *extra,
        F.col("geom").alias(f"geom_{prefix}"),
        box.alias(f"{side}box"),
    )


def overlay_pairs(a: DataFrame, b: DataFrame, pad: float = 0.0, touching: bool = True) -> DataFrame:
    """Box-intersecting pairs with both geometries; the base of every exact predicate below.

    A layer joined with itself is stored once. Without ``touching`` boxes must share some area.
    """
    l, r = F.col("lbox"), F.col("rbox")
    apart = [F.least(l[f"max{n}"], r[f"max{n}"]) <= F.greatest(l[f"min{n}"], r[f"min{n}"]) for n in "xy"]
    met = F.lit(True) if touching else ~(apart[0] | apart[1])
    if a is not b:
        return grid_join(_boxed(a, "a", pad), _boxed(b, "b")).where(met).drop("lbox", "rbox")
    columns = [c for c in ("feature_id", "idx") if c in a.columns]
    stored = cut(a.select(*columns, "geom", bbox("geom").alias("box")))

    def side(p: str, box: str, grown: Column) -> DataFrame:
        names = {"feature_id": f"feature_{p}", "idx": f"idx_{p}", "geom": f"geom_{p}"}
        return stored.select(*[F.col(c).alias(n) for c, n in names.items() if c in stored.columns], grown.alias(box))

    left = side("a", "lbox", expand_bbox("box", pad) if pad else F.col("box"))
    return grid_join(left, side("b", "rbox", F.col("box")), ready=True).where(met).drop("lbox", "rbox")


def intersecting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that share at least one point."""
    return overlay_pairs(a, b).where(k.intersects("geom_a", "geom_b"))


def overlapping(layer: DataFrame) -> DataFrame:
    """Pairs of one layer, idx_a < idx_b, with the shared area in squared units; boxes that only touch share none."""
    pairs = overlay_pairs(layer, layer, touching=False).where("idx_a < idx_b")
    return pairs.withColumn("overlap_units", k.intersection_area("geom_a", "geom_b"))


def neighbours(layer: DataFrame, tolerance: float) -> DataFrame:
    """Ordered pairs of one layer no further apart than ``tolerance``."""
    pairs = overlay_pairs(layer, layer, pad=tolerance).where("idx_a <> idx_b")
    return pairs.withColumn("gap", k.distance("geom_a", "geom_b")).where(F.col("gap") <= tolerance)


def line_pieces(lines: DataFrame, max_length: float) -> DataFrame:
    """Lines cut into straight pieces no longer than ``max_length``: corridor_id, box, s and e (the two ends)."""
    points = F.flatten(F.transform("geom.parts", lambda p: F.zip_with(
        F.slice(p["shell"], 1, F.greatest(F.size(p["shell"]) - 1, F.lit(1))),
        F.slice(p["shell"], F.least(F.size(p["shell"]), F.lit(2)), F.greatest(F.size(p["shell"]) - 1, F.lit(1))),
        lambda s, e: F.struct(s.alias("s"), e.alias("e")),
    )))
    seg = lines.select("corridor_id", F.explode(points).alias("seg"))
    n = F.greatest(
        F.ceil(
            F.hypot(F.col("seg.e.x") - F.col("seg.s.x"), F.col("seg.e.y") - F.col("seg.s.y")) / F.lit(max_length)
        ),
        F.lit(1),
    )
    seg = seg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))

    def at(axis: str, step: Column) -> Column:
        return F.col(f"seg.s.{axis}") + (F.col(f"seg.e.{axis}") - F.col(f"seg.s.{axis}")) * step / F.col("n")

    ends = {ax: (at(ax, F.col("i") - 1), at(ax, F.col("i"))) for ax in "xy"}
    box = F.struct(
        F.least(*ends["x"]).alias("minx"),
        F.least(*ends["y"]).alias("miny"),
        F.greatest(*ends["x"]).alias("maxx"),
        F.greatest(*ends["y"]).alias("maxy"),
    )
    points = [F.struct(ends["x"][i].alias("x"), ends["y"][i].alias("y")).alias(n) for i, n in enumerate("se")]
    return seg.select("corridor_id", box.alias("box"), *points)


def corridor_pairs(corridors: DataFrame, parcels: DataFrame, radius: float) -> DataFrame:
    """(corridor_id, parcel_id, reach): pairs near each other, ``reach`` the pieces of the corridor near the parcel.

    Corridors enter as short pieces, so a long diagonal does not meet everything in its
    box, and a pair carries the few pieces whose boxes, grown by ``radius``, meet the
    parcel's; whatever lies within the radius of the parcel lies on them.
    """
    left = cut(line_pieces(corridors, 8 * MIN_CELL)).select("corridor_id", "s", "e", expand_bbox("box", radius).alias("lbox"))
    right = parcels.select(F.col("feature_id").alias("parcel_id"), bbox("geom").alias("rbox"))
    near = grid_join(left, right, ready="left").groupBy("corridor_id", "parcel_id").agg(F.collect_set(F.struct("s", "e")).alias("pieces"))
    lines = F.transform("pieces", lambda p: part(F.array(p["s"], p["e"])))
    reach = F.struct(F.lit("MultiLineString").alias("type"), lines.alias("parts")).cast(GEOMETRY)
    return near.select("corridor_id", "parcel_id", reach.alias("reach"))


def inside_any(points: DataFrame, polygons: DataFrame, keys: tuple[str, ...] = (), ready: bool | str = False) -> DataFrame:
    """Point rows (pid, x, y) lying inside at least one polygon: distinct (keys, pid). ``ready`` as for ``grid_join``."""
    spot = F.struct(F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    left = points.select(*keys, "pid", "x", "y", spot.alias("lbox"))
    right = polygons.select(*keys, "geom", bbox("geom").alias("rbox"))
    hits = grid_join(left, right, keys, ready=ready).where(k.contains_point("geom", "x", "y"))
    return hits.select(*keys, "pid").distinct()


def expected_absence(a: DataFrame, near: DataFrame, coverage: DataFrame) -> DataFrame:
    """A features without candidate: ``real_gap`` inside the coverage of B, else ``expected_absence``.

    Features are told apart, and named, by dataset and id where ``a`` and ``near`` carry both.
    """
    named = {"dataset_id": "dataset_a", "feature_id": "feature_a"}
    on = [c for c, k in named.items() if c in a.columns and k in near.columns]
    alone = a.join(near.select(*[F.col(named[c]).alias(c) for c in on]).distinct(), on, "left_anti")
    spots = alone.select(F.struct(*on).alias("pid"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    covered = inside_any(spots, coverage).select(*[F.col(f"pid.{c}").alias(c) for c in on], F.lit(True).alias("_in"))
    return alone.join(covered, on, "left").select(*on, F.when(F.col("_in"), "real_gap").otherwise("expected_absence").alias("absence"))


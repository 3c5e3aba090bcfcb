"""Union of many polygons as a distributed boundary computation.

No polygon set is ever gathered. Edges of all polygons are noded against each other
through a grid join, pieces with interior on both sides cancel, and what is left is the
boundary of the union, interior on the left. Rings are found by pointer doubling, whose
rounds grow with the logarithm of the longest ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import kernels as k
from plotweave.functions.geometry import GEOMETRY, part, polygon
from plotweave.operators.spatial_join import MIN_CELL, grid_join, inside_any
from plotweave.session import cut, discard

TOUCH = 1e-11
OFFSET = 1e-10
QUANTUM = 1e13
DOUBLINGS = 3


def _on_grid(v: Column) -> Column:
    """Coordinates on a 1e-13 grid, so that pieces computed twice have equal ends."""
    return F.round(v * QUANTUM) / QUANTUM


def boundary_edges(polygons: DataFrame, group: str) -> DataFrame:
    """Directed ring edges (group, x1, y1, x2, y2) with the polygon on the left."""
    ring = """transform({r}, p -> named_struct('x', p.x, 'y', p.y))"""
    area2 = """aggregate({r}, named_struct('px', double(null), 'py', double(null), 'a', 0D), (s, p) -> named_struct(
        'px', p.x - {r}[0].x, 'py', p.y - {r}[0].y,
        'a', s.a + coalesce(s.px * (p.y - {r}[0].y) - (p.x - {r}[0].x) * s.py, 0D)), s -> s.a)"""

    def facing(r: str, sign: str) -> str:
        return f"if({area2.format(r=r)} {sign} 0, {ring.format(r=r)}, reverse({ring.format(r=r)}))"

    rings = f"""flatten(transform(geom.parts, q -> concat(array({facing('q.shell', '>=')}),
        transform(q.holes, h -> {facing('h', '<=')}))))"""
    rows = polygons.select(group, F.explode(F.expr(" ".join(rings.split()))).alias("r"))
    rows = rows.select(group, F.posexplode("r").alias("i", "p"), "r").where("i > 0")
    start, end = F.get("r", F.col("i") - 1), F.col("p")
    ends = {"x1": start["x"], "y1": start["y"], "x2": end["x"], "y2": end["y"]}
    return rows.select(group, *[_on_grid(v).alias(n) for n, v in ends.items()]).where("x1 <> x2 or y1 <> y2")


def _uncancelled(edges: DataFrame, group: str) -> DataFrame:
    """Distinct pieces seen in one direction only; copies collapse before the shuffle."""
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in
            (("xa", "x1", "x2"), ("ya", "y1", "y2"), ("xb", "x2", "x1"), ("yb", "y2", "y1"))]
    seen = edges.select(group, *ends, ahead.alias("ahead")).groupBy(group, "xa", "ya", "xb", "yb").agg(
        F.bool_or("ahead").alias("fwd"), F.bool_or(~F.col("ahead")).alias("back")
    )
    one_way = seen.where("fwd <> back")
    pick = lambda a, b: F.when(F.col("fwd"), F.col(a)).otherwise(F.col(b))
    return one_way.select(
        group, pick("xa", "xb").alias("x1"), pick("ya", "yb").alias("y1"), pick("xb", "xa").alias("x2"), pick("yb", "ya").alias("y2")
    )


def _box(x1="x1", y1="y1", x2="x2", y2="y2", pad: float = 0.0) -> Column:
    return F.struct(
        (F.least(x1, x2) - pad).alias("minx"),
        (F.least(y1, y2) - pad).alias("miny"),
        (F.greatest(x1, x2) + pad).alias("maxx"),
        (F.greatest(y1, y2) + pad).alias("maxy"),
    )


def _split(edges: DataFrame, group: str) -> DataFrame:
    """Cut every edge where another one of its group touches or crosses it."""
    c = F.col
    left = edges.select(group, "x1", "y1", "x2", "y2", _box(pad=TOUCH).alias("lbox"))
    right = edges.select(group, c("x1").alias("u1"), c("y1").alias("v1"), c("x2").alias("u2"), c("y2").alias("v2"), _box().alias("rbox"))
    pairs = grid_join(left, right, (group,), ready=True).drop("lbox", "rbox")
    pairs = pairs.where("not (x1 = u1 and y1 = v1 and x2 = u2 and y2 = v2)")
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    length2 = dx * dx + dy * dy

    def touch(u: str, v: str) -> Column:
        t = ((c(u) - c("x1")) * dx + (c(v) - c("y1")) * dy) / length2
        off = F.abs((c(u) - c("x1")) * dy - (c(v) - c("y1")) * dx) / F.sqrt(length2)
        inner = (off <= TOUCH) & (t > 0) & (t < 1) & ((c(u) != c("x1")) | (c(v) != c("y1"))) & ((c(u) != c("x2")) | (c(v) != c("y2")))
        return F.when(inner, F.struct(t.alias("t"), c(u).alias("x"), c(v).alias("y")))

    ex, ey = c("u2") - c("u1"), c("v2") - c("v1")
    det = dx * ey - dy * ex
    wx, wy = c("u1") - c("x1"), c("v1") - c("y1")
    safe = F.when(det != 0, det)
    t, s = (wx * ey - wy * ex) / safe, (wx * dy - wy * dx) / safe
    # Both partners must find the same crossing point: always computed from the lower edge.
    low = F.struct("x1", "y1", "x2", "y2") < F.struct("u1", "v1", "u2", "v2")
    x = F.when(low, c("x1") + t * dx).otherwise(c("u1") + s * ex)
    y = F.when(low, c("y1") + t * dy).otherwise(c("v1") + s * ey)
    cross = F.when((t > 0) & (t < 1) & (s > 0) & (s < 1), F.struct(t.alias("t"), _on_grid(x).alias("x"), _on_grid(y).alias("y")))
    cuts = pairs.select(
        group, "x1", "y1", "x2", "y2",
        F.explode(F.filter(F.array(touch("u1", "v1"), touch("u2", "v2"), cross), lambda q: q.isNotNull())).alias("cut"),
    )
    # One row per edge with its cuts in order, so that an edge is shuffled once, not once per end and cut.
    keys = [group, "x1", "y1", "x2", "y2"]
    cuts = cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    end = lambda t, x, y: F.array(F.struct(F.lit(t).alias("t"), c(x).alias("x"), c(y).alias("y")))
    first, last = end(0.0, "x1", "y1"), end(1.0, "x2", "y2")
    inner = F.coalesce("cuts", F.filter(first, lambda p: F.lit(False)))
    step = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    whole = edges.select(*keys).join(cuts, keys, "left")
    pieces = whole.select(group, F.explode(F.zip_with(F.concat(first, inner), F.concat(inner, last), step)).alias("p")).select(group, "p.*")
    return pieces.where("x1 <> x2 or y1 <> y2")


def union_boundary(polygons: DataFrame, group: str) -> DataFrame:
    """Boundary pieces of the union per group, interior on the left."""
    shapes = cut(polygons.select(group, "geom"))
    single = cut(_uncancelled(boundary_edges(shapes, group), group))
    pieces = _uncancelled(_split(single, group), group)
    c = F.col
    length = F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))
    outer = pieces.withColumns(
        {
            "pid": F.monotonically_increasing_id(),
            "x": (c("x1") + c("x2")) / 2 + OFFSET * (c("y2") - c("y1")) / length,
            "y": (c("y1") + c("y2")) / 2 - OFFSET * (c("x2") - c("x1")) / length,
        }
    )
    outer = cut(outer)
    covered = inside_any(outer, shapes.distinct(), (group,), ready="left")
    return outer.join(covered, [group, "pid"], "left_anti").select(group, "x1", "y1", "x2", "y2")


def rings(edges: DataFrame, group: str, max_rounds: int = 64, solid: bool = False) -> DataFrame:
    """Closed rings of boundary pieces: (group, ring, area_units, edges struct rows kept per piece).

    Every piece points to the piece that leaves its end with the rightmost turn, so where
    rings touch in a corner they go round what is outside, and gaps are told apart. With
    ``solid`` it is the leftmost turn: they go round what is inside, and polygons that touch
    in corners are told apart. Labels spread along the pointers, doubling their reach each round.
    """
    e = cut(edges.withColumn("id", F.monotonically_increasing_id()))
    c = F.col
    leaving = e.select(group, c("x1").alias("x2"), c("y1").alias("y2"), c("id").alias("to"), c("x2").alias("x3"), c("y2").alias("y3"))
    dx, dy, fx, fy = c("x2") - c("x1"), c("y2") - c("y1"), c("x3") - c("x2"), c("y3") - c("y2")
    turn = F.atan2(dx * fy - dy * fx, dx * fx + dy * fy)
    step = e.join(leaving, [group, "x2", "y2"]).groupBy("id").agg(F.min_by("to", F.struct(-turn if solid else turn, c("to"))).alias("next"))
    pieces = cut(e.join(step, "id"))
    jump = pieces.select("id", "next", F.least("id", "next").alias("label"), F.lit(False).alias("moved"))
    last = None
    for _ in range(max_rounds):
        for _ in range(DOUBLINGS):
            ahead = jump.select(c("id").alias("next"), c("next").alias("after"), c("label").alias("far"))
            jump = jump.join(ahead, "next").select(
                "id", c("after").alias("next"), F.least("label", "far").alias("label"), (c("far") < c("label")).alias("moved")
            )
        done, jump = last, cut(jump)
        last = jump
        if done is not None:
            discard(done)
        if jump.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("rings did not close")
    return pieces.join(jump.select("id", c("label").alias("ring")), "id")


def ring_sizes(pieces: DataFrame, group: str) -> DataFrame:
    """Signed area per ring: shells positive, holes negative. Local frame: each ring's lowest corner."""
    c = F.col
    corner = pieces.groupBy(group, "ring").agg(F.min("x1").alias("ox"), F.min("y1").alias("oy"))
    cross = (c("x1") - c("ox")) * (c("y2") - c("oy")) - (c("x2") - c("ox")) * (c("y1") - c("oy"))
    return pieces.join(corner, [group, "ring"]).groupBy(group, "ring").agg((F.sum(cross) / 2).alias("area_units"))


def ring_outlines(pieces: DataFrame, group: str) -> DataFrame:
    """(group, ring, outline): one closed coordinate list per ring, the value of one result row."""
    steps = pieces.groupBy(group, "ring").agg(
        F.collect_list(F.struct("id", "next", F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("steps")
    )
    return steps.select(group, "ring", k.chain("steps").alias("outline"))


def nested_rings(polygons: DataFrame, group: str) -> DataFrame:
    """Boundary of the union as rows, one per simple ring: (group, shell, hole, area_units, outline).

    ``shell`` names the shell a ring belongs to, its own if it is one; holes have a
    negative area. No row or task holds all rings of a group: holes meet the shells whose
    boxes enclose theirs. Where there is one such shell, as nearly always, it is the owner.
    Otherwise the pieces of those shells in the hole's slab of x are counted below a point
    of the hole, an odd count is inside, and the smallest shell around it owns the hole.
    """
    c = F.col
    outlines = ring_outlines(rings(union_boundary(polygons, group), group, solid=True), group)
    split = outlines.select(group, "ring", F.posexplode(k.simple_rings("outline")).alias("n", "r"))
    xs, ys = F.transform("r.outline", lambda p: p["x"]), F.transform("r.outline", lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    simple = cut(
        split.where("r.area <> 0").select(
            group, F.struct("ring", "n").alias("id"), c("r.area").alias("area_units"), box.alias("box"), c("r.outline").alias("outline")
        )
    )
    shells, holes = simple.where("area_units > 0"), simple.where("area_units < 0")
    mid = lambda axis: (c("outline")[0][axis] + c("outline")[1][axis]) / 2
    inner = holes.select(
        group, c("id").alias("hole"), (-c("area_units")).alias("lost"), c("box").alias("lbox"), mid("x").alias("x"), mid("y").alias("y")
    )
    outer = shells.select(group, c("id").alias("shell"), c("area_units").alias("size"), c("box").alias("rbox"))
    l, r = c("lbox"), c("rbox")
    encloses = (r["minx"] <= l["minx"]) & (l["maxx"] <= r["maxx"]) & (r["miny"] <= l["miny"]) & (l["maxy"] <= r["maxy"])
    pairs = grid_join(inner, outer, (group,), ready=True).where(encloses & (c("size") > c("lost")))
    rivals = F.count(F.lit(1)).over(Window.partitionBy(group, "hole"))
    pairs = cut(pairs.select(group, "hole", "shell", "size", "x", "y", rivals.alias("rivals")))

    names = [group, "hole", "shell", "size"]
    unsure = pairs.where("rivals > 1")
    asked = unsure.select(*names, "x", "y", F.floor(c("x") / MIN_CELL).alias("slab"))
    walls = shells.join(unsure.select(group, c("shell").alias("id")).distinct(), [group, "id"], "left_semi")
    walls = walls.select(group, c("id").alias("shell"), F.posexplode("outline").alias("i", "p"), "outline").where("i > 0")
    start, end = F.get("outline", c("i") - 1), c("p")
    walls = walls.select(group, "shell", start["x"].alias("x1"), start["y"].alias("y1"), end["x"].alias("x2"), end["y"].alias("y2"))
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    walls = walls.where("x1 <> x2").withColumn("slab", F.explode(F.sequence(F.floor(low / MIN_CELL), F.floor(high / MIN_CELL))))
    height = c("y1") + (c("x") - c("x1")) * (c("y2") - c("y1")) / (c("x2") - c("x1"))
    below = (low <= c("x")) & (c("x") < high) & (height < c("y"))
    crossed = asked.join(walls, [group, "shell", "slab"]).where(below).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    around = pairs.where("rivals = 1").select(*names).unionByName(crossed.where("n % 2 = 1").select(*names))
    owner = around.groupBy(group, "hole").agg(F.min_by("shell", F.struct("size", "shell")).alias("shell"))

    own = shells.select(group, c("id").alias("shell"), F.lit(False).alias("hole"), "area_units", "outline")
    owned = holes.join(owner.withColumnRenamed("hole", "id"), [group, "id"])
    return own.unionByName(owned.select(group, "shell", F.lit(True).alias("hole"), "area_units", "outline"))


def dissolved_parts(polygons: DataFrame, group: str) -> DataFrame:
    """The union as rows, one per polygon: (group, area_units, geom). A row holds one shell and its holes."""
    outline = F.col("outline")
    rows = nested_rings(polygons, group).groupBy(group, "shell").agg(
        F.sum("area_units").alias("area_units"),
        F.max(F.when(~F.col("hole"), outline)).alias("around"),
        F.collect_list(F.when(F.col("hole"), outline)).alias("holes"),
    )
    return rows.select(group, "area_units", polygon(F.col("around"), F.col("holes")).alias("geom"))


def dissolve(polygons: DataFrame, group: str) -> DataFrame:
    """One (multi)polygon per group, the value of one result row: (group, geom), the largest part first."""
    first = F.col("geom.parts")[0]
    ranked = F.struct((-F.col("area_units")).alias("rank"), part(first["shell"], first["holes"]).alias("p"))
    whole = dissolved_parts(polygons, group).groupBy(group).agg(F.array_sort(F.collect_list(ranked)).alias("ps"))
    kind = F.when(F.size("ps") > 1, "MultiPolygon").otherwise("Polygon")
    return whole.select(group, F.struct(kind.alias("type"), F.transform("ps", lambda v: v["p"]).alias("parts")).cast(GEOMETRY).alias("geom"))


def gaps(polygons: DataFrame, group: str, low_units: float, high_units: float) -> DataFrame:
    """Holes of the union whose area lies in the given range: (group, gap, area_units, geom)."""
    pieces = cut(rings(union_boundary(polygons, group), group))
    sizes = ring_sizes(pieces, group).withColumn("area_units", -F.col("area_units"))
    small = sizes.where(F.col("area_units").between(low_units, high_units))
    kept = pieces.join(small, [group, "ring"], "left_semi")
    outlines = ring_outlines(kept, group).join(small, [group, "ring"])
    flipped = F.reverse("outline")
    return outlines.select(
        group, F.col("ring").alias("gap"), "area_units", k.assemble(F.array(flipped)).alias("geom")
    )

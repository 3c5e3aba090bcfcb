"""Arrow UDFs for the pair geometry that Spark has no built-in expression for.

Each kernel works on a whole Arrow batch with numpy; Spark decides which pairs exist.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.functions import outline as ol
from plotweave.functions import ragged as rg
from plotweave.functions.geometry import GEOMETRY_TYPE, RING_TYPE


def _once(udf):
    """Keep the optimizer from moving a kernel into a filter as well, which would run it twice per row."""
    return udf.asNondeterministic()


def _intersection(a: rg.Edges, b: rg.Edges) -> np.ndarray:
    """Area shared by two polygons, row by row, for any simple polygons with holes.

    The indicator of a polygon is the signed sum of the strips below its edges, so the
    shared area is the signed sum, over edge pairs, of the integral of the lower edge
    over the common x-range. No clipping and no special case for touching edges.
    """
    n = a.n_rows
    base = np.minimum(rg._row_min(a.row, np.minimum(a.y1, a.y2), n), rg._row_min(b.row, np.minimum(b.y1, b.y2), n))
    origin = rg._row_min(a.row, a.x1, n)
    a, b = a.pick(a.x1 != a.x2), b.pick(b.x1 != b.x2)
    total = np.zeros(n)
    for i, j in rg.products(a.row, b.row, n):
        row = a.row[i]
        ox, oy = origin[row], base[row]
        ax1, ax2, ay1, ay2 = a.x1[i] - ox, a.x2[i] - ox, a.y1[i] - oy, a.y2[i] - oy
        bx1, bx2, by1, by2 = b.x1[j] - ox, b.x2[j] - ox, b.y1[j] - oy, b.y2[j] - oy
        lo = np.maximum(np.minimum(ax1, ax2), np.minimum(bx1, bx2))
        hi = np.minimum(np.maximum(ax1, ax2), np.maximum(bx1, bx2))
        width = np.maximum(hi - lo, 0.0)
        sa, sb = (ay2 - ay1) / (ax2 - ax1), (by2 - by1) / (bx2 - bx1)
        a_lo, a_hi = ay1 + (lo - ax1) * sa, ay1 + (hi - ax1) * sa
        b_lo, b_hi = by1 + (lo - bx1) * sb, by1 + (hi - bx1) * sb
        d_lo, d_hi = a_lo - b_lo, a_hi - b_hi
        low, high = np.minimum(a_lo, b_lo), np.minimum(a_hi, b_hi)
        crosses = d_lo * d_hi < 0
        t = np.where(crosses, d_lo / np.where(crosses, d_lo - d_hi, 1.0), 0.0)
        mid = np.where(crosses, a_lo + t * (a_hi - a_lo), low)
        strip = width * (t * (low + mid) + (1 - t) * (mid + high)) / 2.0
        sign = np.sign(a.x1[i] - a.x2[i]) * a.weight[i] * np.sign(b.x1[j] - b.x2[j]) * b.weight[j]
        total += np.bincount(row, weights=sign * strip, minlength=n)
    return np.maximum(total, 0.0)


@_once
@F.arrow_udf(T.DoubleType())
def intersection_area(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_intersection(rg.edges(a), rg.edges(b)))


def _segments(geom) -> rg.Edges:
    """Edges, with bare points as zero-length edges."""
    e = rg.edges(geom)
    r = rg.rings(geom)
    starts = np.cumsum(r.size) - r.size
    lone = np.flatnonzero(r.size == 1)
    if not len(lone):
        return e
    x, y = r.x[starts[lone]], r.y[starts[lone]]
    row = np.concatenate([e.row, r.row[lone]])
    order = np.argsort(row, kind="stable")
    cols = [(e.x1, x), (e.y1, y), (e.x2, x), (e.y2, y), (e.weight, np.zeros(len(lone)))]
    return rg.Edges(e.n_rows, row[order], *(np.concatenate(c)[order] for c in cols))


def _point_segment(px, py, x1, y1, x2, y2) -> np.ndarray:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(length2 > 0, length2, 1.0), 0.0, 1.0)
    return np.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def _nearest(a: rg.Edges, b: rg.Edges) -> np.ndarray:
    """For each start vertex of a: distance to the boundary of b."""
    best = np.full(len(a.row), np.inf)
    for i, j in rg.products(a.row, b.row, a.n_rows):
        d = _point_segment(a.x1[i], a.y1[i], b.x1[j], b.y1[j], b.x2[j], b.y2[j])
        np.minimum.at(best, i, d)
    return best


def _both_ends(e: rg.Edges) -> rg.Edges:
    """Every vertex as a start vertex, so that open lines keep their last point."""
    row = np.repeat(e.row, 2)
    x, y = np.column_stack([e.x1, e.x2]).ravel(), np.column_stack([e.y1, e.y2]).ravel()
    return rg.Edges(e.n_rows, row, x, y, x, y, np.zeros(len(row)))


@_once
@F.arrow_udf(T.DoubleType())
def hausdorff(a: pa.Array, b: pa.Array) -> pa.Array:
    """Discrete Hausdorff distance: each vertex to the other boundary, larger of both ways."""
    ea, eb = _segments(a), _segments(b)
    out = np.full(ea.n_rows, -1.0)
    for e, other in ((ea, eb), (eb, ea)):
        v = _both_ends(e)
        np.maximum.at(out, v.row, _nearest(v, other))
    return pa.array(out, mask=~np.isfinite(out) | (out < 0))


def _crossing(a: rg.Edges, b: rg.Edges) -> np.ndarray:
    hit = np.zeros(a.n_rows, bool)
    for i, j in rg.products(a.row, b.row, a.n_rows):
        def side(ox, oy, dx, dy, px, py):
            return np.sign((dx - ox) * (py - oy) - (dy - oy) * (px - ox))

        ax1, ay1, ax2, ay2 = a.x1[i], a.y1[i], a.x2[i], a.y2[i]
        bx1, by1, bx2, by2 = b.x1[j], b.y1[j], b.x2[j], b.y2[j]
        boxes = (
            (np.minimum(ax1, ax2) <= np.maximum(bx1, bx2))
            & (np.minimum(bx1, bx2) <= np.maximum(ax1, ax2))
            & (np.minimum(ay1, ay2) <= np.maximum(by1, by2))
            & (np.minimum(by1, by2) <= np.maximum(ay1, ay2))
        )
        split_b = side(ax1, ay1, ax2, ay2, bx1, by1) * side(ax1, ay1, ax2, ay2, bx2, by2) <= 0
        split_a = side(bx1, by1, bx2, by2, ax1, ay1) * side(bx1, by1, bx2, by2, ax2, ay2) <= 0
        hit[a.row[i][boxes & split_a & split_b]] = True
    return hit


def _inside(e: rg.Edges, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd ray cast of one point per row."""
    px, py = x[e.row], y[e.row]
    spans = (e.y1 > py) != (e.y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = e.x1 + (py - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
    return np.bincount(e.row, weights=(spans & (px < at)), minlength=e.n_rows) % 2 == 1


def _first_vertex(e: rg.Edges) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full(e.n_rows, np.nan), np.full(e.n_rows, np.nan)
    x[e.row[::-1]], y[e.row[::-1]] = e.x1[::-1], e.y1[::-1]
    return x, y


def _touches(ea: rg.Edges, eb: rg.Edges) -> np.ndarray:
    return (
        _crossing(ea, eb)
        | ((np.bincount(eb.row, weights=np.abs(eb.weight), minlength=eb.n_rows) > 0) & _inside(eb, *_first_vertex(ea)))
        | ((np.bincount(ea.row, weights=np.abs(ea.weight), minlength=ea.n_rows) > 0) & _inside(ea, *_first_vertex(eb)))
    )


@F.arrow_udf(T.BooleanType())
def intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share at least one point; touching counts."""
    return pa.array(_touches(_segments(a), _segments(b)))


@_once
@F.arrow_udf(T.DoubleType())
def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    ea, eb = _segments(a), _segments(b)
    out = np.full(ea.n_rows, np.inf)
    for e, other in ((ea, eb), (eb, ea)):
        v = _both_ends(e)
        np.minimum.at(out, v.row, _nearest(v, other))
    return pa.array(np.where(_touches(ea, eb), 0.0, out))


@F.arrow_udf(T.BooleanType())
def contains_point(geom: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    inside = _inside(rg.edges(geom), x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False))
    return pa.array(inside)


@_once
@F.arrow_udf(T.DoubleType())
def contact_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of collinear shared boundary, edges no further apart than 1e-7."""
    ea, eb = rg.edges(a), rg.edges(b)
    out = np.zeros(ea.n_rows)
    for i, j in rg.products(ea.row, eb.row, ea.n_rows):
        dx, dy = ea.x2[i] - ea.x1[i], ea.y2[i] - ea.y1[i]
        length = np.hypot(dx, dy)
        ok = length > 0
        ux, uy = dx / np.where(ok, length, 1.0), dy / np.where(ok, length, 1.0)

        def along(x, y):
            return (x - ea.x1[i]) * ux + (y - ea.y1[i]) * uy, np.abs((y - ea.y1[i]) * ux - (x - ea.x1[i]) * uy)

        t1, off1 = along(eb.x1[j], eb.y1[j])
        t2, off2 = along(eb.x2[j], eb.y2[j])
        shared = np.minimum(np.maximum(t1, t2), length) - np.maximum(np.minimum(t1, t2), 0.0)
        close = ok & (off1 <= 1e-7) & (off2 <= 1e-7) & (shared > 0)
        out += np.bincount(ea.row[i], weights=np.where(close, shared, 0.0), minlength=ea.n_rows)
    return pa.array(out)


def _overlay(a: pa.Array, b: pa.Array, rule) -> pa.Array:
    return _outlines([a, b], rule, turn=True)


def _outlines(geoms: list, rule, turn: bool) -> pa.Array:
    """Rows that are left with one plain ring, as nearly all, are written column by column, the others one by one."""
    n = len(geoms[0])
    xy, node_row, start, end = ol.boundaries(*rg.segments(geoms, turn), n, len(geoms), rule)
    rows, size, points = ol.lone_rings(xy, node_row, start, end, n)
    plain = np.zeros(n, bool)
    plain[rows] = True
    rest, others = ~plain[node_row[start]], np.flatnonzero(~plain)
    found = ol.walked(xy, node_row, start[rest], end[rest], n)
    columns = [rg.polygon_array(size, points), rg.geometry_array([rg.to_geometry(found[at]) for at in others.tolist()])]
    return pa.concat_arrays(columns).take(pa.array(np.argsort(np.concatenate([rows, others]))))


@_once
@F.arrow_udf(GEOMETRY_TYPE)
def clip(a: pa.Array, b: pa.Array) -> pa.Array:
    """Outline of the intersection."""
    return _overlay(a, b, lambda w: (w[0] > 0) & (w[1] > 0))


@_once
@F.arrow_udf(GEOMETRY_TYPE)
def subtract(a: pa.Array, b: pa.Array) -> pa.Array:
    """Outline of a without b."""
    return _overlay(a, b, lambda w: (w[0] > 0) & (w[1] <= 0))


@_once
@F.arrow_udf(GEOMETRY_TYPE)
def join_outline(a: pa.Array, b: pa.Array) -> pa.Array:
    """Outline of the union of two geometries."""
    return _overlay(a, b, lambda w: (w[0] > 0) | (w[1] > 0))


@_once
@F.arrow_udf(GEOMETRY_TYPE)
def make_valid(geom: pa.Array) -> pa.Array:
    """Even-odd interpretation of the rings; null when no area is left."""
    return _outlines([geom], lambda w: np.abs(w[0]) % 2 == 1, turn=False)


def _valid_rows(geom: pa.Array) -> np.ndarray:
    """Rings closed, of positive area, and free of self-contact; rings of one feature may touch in points."""
    r = rg.rings(geom)
    stops = np.cumsum(r.size)
    starts = stops - r.size
    some = r.size > 0
    first, last = starts[some], stops[some] - 1
    fine = np.ones(len(r.size), bool)
    fine[some] = (r.size[some] > 3) & (r.x[first] == r.x[last]) & (r.y[first] == r.y[last])

    ring_of_point = np.repeat(np.arange(len(r.size)), r.size)
    step = np.flatnonzero(ring_of_point[:-1] == ring_of_point[1:]) if len(r.x) else np.empty(0, int)
    step = step[(r.x[step] != r.x[step + 1]) | (r.y[step] != r.y[step + 1])]
    ring = ring_of_point[step]
    order = np.argsort(r.row[ring], kind="stable")
    step, ring = step[order], ring[order]
    row = r.row[ring]
    x1, y1, x2, y2 = r.x[step], r.y[step], r.x[step + 1], r.y[step + 1]
    ox, oy = r.x[starts[ring]], r.y[starts[ring]]
    cross = (x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)
    fine &= ~some | (np.bincount(ring, weights=cross, minlength=len(r.size)) != 0)
    edge_count = np.bincount(ring, minlength=len(r.size))
    by_ring = np.argsort(ring, kind="stable")
    place = np.empty(len(ring), np.int64)
    place[by_ring] = np.arange(len(ring)) - np.repeat(np.cumsum(edge_count) - edge_count, edge_count)

    bad = np.bincount(r.row, weights=~fine, minlength=r.n_rows) > 0
    for i, j in rg.products(row, row, r.n_rows):
        later = i < j
        i, j = i[later], j[later]
        meet = (
            (np.minimum(x1[i], x2[i]) <= np.maximum(x1[j], x2[j]))
            & (np.minimum(x1[j], x2[j]) <= np.maximum(x1[i], x2[i]))
            & (np.minimum(y1[i], y2[i]) <= np.maximum(y1[j], y2[j]))
            & (np.minimum(y1[j], y2[j]) <= np.maximum(y1[i], y2[i]))
        )
        i, j = i[meet], j[meet]
        dx, dy, ex, ey = x2[i] - x1[i], y2[i] - y1[i], x2[j] - x1[j], y2[j] - y1[j]
        s1 = np.sign(dx * (y1[j] - y1[i]) - dy * (x1[j] - x1[i]))
        s2 = np.sign(dx * (y2[j] - y1[i]) - dy * (x2[j] - x1[i]))
        s3 = np.sign(ex * (y1[i] - y1[j]) - ey * (x1[i] - x1[j]))
        s4 = np.sign(ex * (y2[i] - y1[j]) - ey * (x2[i] - x1[j]))
        contact = (s1 * s2 <= 0) & (s3 * s4 <= 0)
        along = (s1 == 0) & (s2 == 0)
        same = ring[i] == ring[j]
        gap = np.abs(place[i] - place[j])
        beside = same & ((gap == 1) | (gap == edge_count[ring[i]] - 1))
        folded = along & (dx * ex + dy * ey < 0)
        t1, t2 = (x1[j] - x1[i]) * dx + (y1[j] - y1[i]) * dy, (x2[j] - x1[i]) * dx + (y2[j] - y1[i]) * dy
        shared = along & (np.minimum(np.maximum(t1, t2), dx * dx + dy * dy) > np.maximum(np.minimum(t1, t2), 0.0))
        crossing = (s1 * s2 < 0) & (s3 * s4 < 0)
        wrong = np.where(beside, folded, np.where(same, contact, crossing | shared))
        bad[row[i[wrong]]] = True
    several = np.flatnonzero((np.bincount(r.row, minlength=r.n_rows) > 1) & ~bad)
    if len(several):
        by_row = np.argsort(r.row, kind="stable")
        edge = np.searchsorted(r.row[by_row], several), np.searchsorted(r.row[by_row], several, "right")
        for at, lo, hi in zip(several, *edge):
            bad[at] = _misplaced(r, starts, stops, by_row[lo:hi])
    return ~bad


def _side(x: np.ndarray, y: np.ndarray, ring_x: np.ndarray, ring_y: np.ndarray) -> np.ndarray:
    """1 for points strictly inside a ring, -1 strictly outside, 0 on it."""
    x1, y1, x2, y2 = ring_x[:-1], ring_y[:-1], ring_x[1:], ring_y[1:]
    px, py = x[:, None], y[:, None]
    cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    on = (cross == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2))
    on &= (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    crossed = ((y1 > py) != (y2 > py)) & ((cross > 0) == (y2 > y1))
    return np.where(on.any(1), 0, np.where(crossed.sum(1) % 2 == 1, 1, -1))


def _misplaced(r: rg.Rings, starts: np.ndarray, stops: np.ndarray, own: np.ndarray) -> bool:
    """Whether a hole leaves its shell or lies in another hole, or a part lies in another part.

    The rings do not cross, so one point off the other ring decides each pair.
    """
    points = {k: (r.x[starts[k] : stops[k]], r.y[starts[k] : stops[k]]) for k in own}

    def where(a: int, b: int) -> int:
        sides = _side(*points[a], *points[b])
        off = sides[sides != 0]
        return int(off[0]) if len(off) else 0

    shells = [k for k in own if not r.hole[k]]
    for k in own:
        mates = [m for m in own if m != k and r.part[m] == r.part[k]]
        if r.hole[k]:
            if any(where(k, m) == (1 if r.hole[m] else -1) for m in mates):
                return True
            continue
        for other in shells:
            if other != k and where(k, other) == 1:
                holes = [m for m in own if r.hole[m] and r.part[m] == r.part[other]]
                if not any(where(k, m) == 1 for m in holes):
                    return True
    return False


@_once
@F.arrow_udf(T.BooleanType())
def is_valid(geom: pa.Array) -> pa.Array:
    """Valid polygon rings; lines and points pass."""
    kinds = pc.is_in(pc.struct_field(geom, "type"), value_set=pa.array(["Polygon", "MultiPolygon"]))
    polygonal = kinds.to_numpy(zero_copy_only=False)
    return pa.array(~polygonal | _valid_rows(geom))


@_once
@F.arrow_udf(GEOMETRY_TYPE)
def convex_hull(geom: pa.Array) -> pa.Array:
    out = []
    for rr in rg.row_rings(geom):
        hull = ol.hull(np.concatenate([r for r, _ in rr])) if rr else []
        out.append(rg.to_geometry([(hull, [])]) if len(hull) > 3 else None)
    return rg.geometry_array(out)


def buffer(radius: float, quad_segs: int = 16):
    """UDF growing a line or point by ``radius`` with round joins and caps."""

    @F.arrow_udf(GEOMETRY_TYPE)
    def grow(geom: pa.Array) -> pa.Array:
        out = []
        for rr in rg.row_rings(geom):
            capsules = [
                ol.capsule(p, q, radius, quad_segs) for r, _ in rr for p, q in zip(r[:-1], r[1:])
            ] or [ol.capsule(r[0], r[0], radius, quad_segs) for r, _ in rr if len(r)]
            shapes = ol.regions([capsules], lambda w: w[0] > 0) if len(capsules) > 1 else [(c, []) for c in capsules]
            out.append(rg.to_geometry(shapes))
        return rg.geometry_array(out)

    return grow


@_once
@F.arrow_udf(GEOMETRY_TYPE)
def assemble(rings: pa.Array) -> pa.Array:
    """Boundary rings (interior on the left) of one feature into a polygon with its holes."""
    out = []
    for group in rings.to_pylist():
        loops = [np.array([(p["x"], p["y"]) for p in r]) for r in group or []]
        out.append(rg.to_geometry(ol.nest([s for r in loops for s in ol.split_pinches(r)])))
    return rg.geometry_array(out)


SIMPLE_RINGS_TYPE = T.ArrayType(T.StructType([T.StructField("area", T.DoubleType()), T.StructField("outline", RING_TYPE)]))


@_once
@F.arrow_udf(SIMPLE_RINGS_TYPE)
def simple_rings(outline: pa.Array) -> pa.Array:
    """A closed ring as simple rings with their signed areas: one that revisits a vertex falls into several."""
    out = []
    for ring in outline.to_pylist():
        loops = ol.split_pinches(np.array([(p["x"], p["y"]) for p in ring]))
        out.append([{"area": ol.ring_area(r), "outline": [{"x": x, "y": y} for x, y in r.tolist()]} for r in loops])
    return pa.array(out, type=pa.list_(pa.struct([("area", pa.float64()), ("outline", rg.RING_T)])))


@_once
@F.arrow_udf(RING_TYPE)
def chain(steps: pa.Array) -> pa.Array:
    """One ring from its edges given as (id, next, x, y), in walking order, closed."""
    out = []
    for group in steps.to_pylist():
        at = {s["id"]: s for s in group}
        ring, key = [], min(at)
        for _ in range(len(at)):
            ring.append({"x": at[key]["x"], "y": at[key]["y"]})
            key = at[key]["next"]
        out.append(ring + ring[:1])
    return pa.array(out, type=rg.RING_T)

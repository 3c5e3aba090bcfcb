"""Arrow geometry columns as flat numpy edge tables, and back."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

POINT_T = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RING_T = pa.list_(POINT_T)
GEOMETRY_T = pa.struct(
    [
        ("type", pa.string()),
        ("parts", pa.list_(pa.struct([("shell", RING_T), ("holes", pa.list_(RING_T))]))),
    ]
)


@dataclass
class Rings:
    """Rings of a batch of geometries: ``row``, ``part`` and ``hole`` per ring, points concatenated."""

    n_rows: int
    row: np.ndarray
    part: np.ndarray
    hole: np.ndarray
    size: np.ndarray
    x: np.ndarray
    y: np.ndarray


@dataclass
class Edges:
    """Edges sorted by row. ``weight`` is +1/-1 so that shells count positive, holes negative."""

    n_rows: int
    row: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    weight: np.ndarray

    def pick(self, mask: np.ndarray) -> Edges:
        return Edges(self.n_rows, *(v[mask] for v in (self.row, self.x1, self.y1, self.x2, self.y2, self.weight)))


def _lengths(lists) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _xy(points) -> tuple[np.ndarray, np.ndarray]:
    return tuple(points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))


def rings(geom) -> Rings:
    if isinstance(geom, pa.ChunkedArray):
        geom = geom.combine_chunks()
    parts_list = pc.struct_field(geom, "parts")
    n = len(geom)
    part_row = np.repeat(np.arange(n), _lengths(parts_list))
    parts = parts_list.flatten()
    shells, holes_list = parts.field(0), parts.field(1)
    hole_part = np.repeat(np.arange(len(part_row)), _lengths(holes_list))
    hole_row = part_row[hole_part]
    holes = holes_list.flatten()
    sx, sy = _xy(shells.flatten())
    hx, hy = _xy(holes.flatten())
    return Rings(
        n,
        np.concatenate([part_row, hole_row]),
        np.concatenate([np.arange(len(part_row)), hole_part]),
        np.repeat([False, True], [len(part_row), len(hole_row)]),
        np.concatenate([_lengths(shells), _lengths(holes)]),
        np.concatenate([sx, hx]),
        np.concatenate([sy, hy]),
    )


def edges(geom) -> Edges:
    r = rings(geom)
    starts = np.concatenate([[0], np.cumsum(r.size)])[:-1]
    ring_of_point = np.repeat(np.arange(len(r.size)), r.size)
    inner = np.ones(len(r.x), bool)
    ends = starts + r.size - 1
    inner[ends[r.size > 0]] = False
    i = np.flatnonzero(inner)
    ring = ring_of_point[i]
    x1, y1 = r.x[i], r.y[i]
    x2, y2 = (r.x[i + 1], r.y[i + 1]) if len(i) else (x1, y1)
    ox, oy = r.x[starts[ring]], r.y[starts[ring]]
    cross = (x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)
    signed = np.bincount(ring, weights=cross, minlength=len(r.size))
    weight = np.sign(signed) * np.where(r.hole, -1.0, 1.0)
    order = np.argsort(r.row[ring], kind="stable")
    pick = ring[order]
    return Edges(r.n_rows, r.row[pick], x1[order], y1[order], x2[order], y2[order], weight[pick])


def segments(geoms: list, turn: bool) -> tuple[np.ndarray, ...]:
    """Segments of the rings of several geometry columns, sorted by row: (p, q, row, layer), the column as the layer.

    With ``turn`` shells run counter-clockwise and holes clockwise, and rings of less than four points are left out.
    """
    found = []
    for layer, geom in enumerate(geoms):
        r = rings(geom)
        starts, count = np.cumsum(r.size) - r.size, np.maximum(r.size - 1, 0)
        ring = np.repeat(np.arange(len(r.size)), count)
        before = np.cumsum(count) - count
        step = np.arange(len(ring)) - np.repeat(before, count)
        p = starts[ring] + step
        q = p + 1
        if turn:
            ox, oy = r.x[starts[ring]], r.y[starts[ring]]
            gain, loss = (r.x[p] - ox) * (r.y[q] - oy), (r.x[q] - ox) * (r.y[p] - oy)
            twice, scale = (np.bincount(ring, weights=v, minlength=len(r.size)) for v in (gain - loss, np.abs(gain) + np.abs(loss)))
            for k in np.flatnonzero((np.abs(twice) <= 1e-9 * scale) & (r.size > 3)):  # the order of the sum decides
                twice[k] = np.sum((gain - loss)[before[k] : before[k] + count[k]])
            back = ((twice >= 0) == r.hole)[ring]
            low = np.where(back, starts[ring] + r.size[ring] - 2 - step, p)
            p, q = np.where(back, low + 1, low), np.where(back, low, low + 1)
            some = (r.size > 3)[ring]
            p, q, ring = p[some], q[some], ring[some]
        xy = np.column_stack([r.x, r.y])
        found.append((xy[p], xy[q], r.row[ring], np.full(len(ring), layer)))
    p, q, row, layer = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((layer, row))
    return p[order], q[order], row[order], layer[order]


def areas(e: Edges) -> np.ndarray:
    ox, oy = _row_min(e.row, e.x1, e.n_rows), _row_min(e.row, e.y1, e.n_rows)
    x1, x2, y1, y2 = e.x1 - ox[e.row], e.x2 - ox[e.row], e.y1 - oy[e.row], e.y2 - oy[e.row]
    return np.bincount(e.row, weights=e.weight * (x1 * y2 - x2 * y1), minlength=e.n_rows) / 2.0


def _row_min(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.inf)
    np.minimum.at(out, row, values)
    return np.where(np.isfinite(out), out, 0.0)


def products(row_a: np.ndarray, row_b: np.ndarray, n_rows: int, block: int = 1 << 16):
    """Index pairs (i, j) with equal row, in bounded blocks. Both inputs are sorted by row."""
    count_b = np.bincount(row_b, minlength=n_rows)
    first_b = np.concatenate([[0], np.cumsum(count_b)])[:-1]
    reps = count_b[row_a]
    done = np.concatenate([[0], np.cumsum(reps)])
    lo = 0
    while lo < len(row_a):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + block, side="right")) - 1)
        r = reps[lo:hi]
        i = np.repeat(np.arange(lo, hi), r)
        offset = np.arange(len(i)) - np.repeat(np.concatenate([[0], np.cumsum(r)])[:-1], r)
        yield i, np.repeat(first_b[row_a[lo:hi]], r) + offset
        lo = hi


def row_rings(geom) -> list[list[tuple[np.ndarray, bool]]]:
    """Per row, the list of (ring coordinates, is_hole)."""
    r = rings(geom)
    out: list[list[tuple[np.ndarray, bool]]] = [[] for _ in range(r.n_rows)]
    stops = np.cumsum(r.size)
    xy = np.column_stack([r.x, r.y])
    for row, hole, size, stop in zip(r.row, r.hole, r.size, stops):
        out[row].append((xy[stop - size : stop], bool(hole)))
    return out


def to_geometry(polygons: list[tuple[np.ndarray, list[np.ndarray]]]) -> dict | None:
    """[(shell, [hole, ...])] as one geometry record; None when nothing is left."""
    if not polygons:
        return None

    def ring(r):
        return [{"x": x, "y": y} for x, y in r.tolist()]

    return {
        "type": "Polygon" if len(polygons) == 1 else "MultiPolygon",
        "parts": [{"shell": ring(s), "holes": [ring(h) for h in hs]} for s, hs in polygons],
    }


def geometry_array(records: list[dict | None]) -> pa.Array:
    return pa.array(records, type=GEOMETRY_T)


def polygon_array(size: np.ndarray, points: np.ndarray) -> pa.Array:
    """Polygons without holes, one row per closed ring: points per ring, and the points of all rings."""
    n = len(size)
    kind, parts = GEOMETRY_T.field("type"), GEOMETRY_T.field("parts")
    fields = list(parts.type.value_type)
    offsets = lambda counts: pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    x, y = (pa.array(np.ascontiguousarray(points[:, i])) for i in (0, 1))
    shells = pa.ListArray.from_arrays(offsets(size), pa.StructArray.from_arrays([x, y], fields=list(POINT_T)))
    holes = pa.ListArray.from_arrays(offsets(np.zeros(n, np.int64)), pa.array([], RING_T))
    part = pa.StructArray.from_arrays([shells, holes], fields=fields)
    listed = pa.ListArray.from_arrays(offsets(np.ones(n, np.int64)), part)
    return pa.StructArray.from_arrays([pa.array(["Polygon"] * n, pa.string()), listed], fields=[kind, parts])

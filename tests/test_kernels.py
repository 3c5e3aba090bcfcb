"""Memory of the pair kernels: it follows the batch, not the product of its outlines."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plotweave.functions import kernels as k
from plotweave.functions import outline as ol
from plotweave.functions import ragged as rg
from plotweave.functions import text as tx


def rounds(n, corners, seed):
    turn = np.linspace(0, 2 * np.pi, corners + 1)
    turn[-1] = 0
    out = []
    for x, y in np.random.default_rng(seed).random((n, 2)):
        out.append(rg.to_geometry([(np.column_stack([x + np.cos(turn) / 10, y + np.sin(turn) / 10]), [])]))
    return rg.geometry_array(out)


@pytest.mark.parametrize("kernel", [k.intersection_area, k.hausdorff], ids=["intersection_area", "hausdorff"])
def test_pairs_of_many_edges_are_taken_in_small_blocks(kernel):
    a, b = rounds(1500, 40, 1), rounds(1500, 40, 2)  # 2.4 million pairs of edges
    kernel.func(a, b)
    tracemalloc.start()
    whole = kernel.func(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parts = [v for at in range(0, 1500, 100) for v in kernel.func(a[at : at + 100], b[at : at + 100]).to_pylist()]
    assert np.allclose(whole.to_pylist(), parts, rtol=1e-9, atol=1e-12)
    assert peak < 60e6


def boxes(x, y, w, h):
    corners = np.stack([np.column_stack([x, y]), np.column_stack([x + w, y]), np.column_stack([x + w, y + h]), np.column_stack([x, y + h]), np.column_stack([x, y])], 1)
    return rg.geometry_array([rg.to_geometry([(c, [])]) for c in corners])


def test_plain_outlines_are_written_column_by_column(monkeypatch):
    i = np.arange(500)
    x, y = 77 + i % 50 * 1e-3, 28 + i // 50 * 1e-3
    a, strips = boxes(x, y, 1e-3, 1e-3), boxes(x - 1e-3, y + 3e-4, 3e-3, 3e-4)
    sought = ol.row_regions(*rg.segments([a, strips], True), 500, 2, lambda w: (w[0] > 0) & (w[1] > 0))
    alone = []
    monkeypatch.setattr(ol, "nest", lambda rings, nest=ol.nest: alone.append(rings) or nest(rings))
    assert k.clip.func(a, strips).to_pylist() == [rg.to_geometry(r) for r in sought]
    assert not alone
    assert k.subtract.func(a, strips).to_pylist()[0]["type"] == "MultiPolygon"  # several rings are nested row by row
    assert len(alone) == 500


def test_texts_are_compared_once_for_many_batches(monkeypatch):
    swept = []
    monkeypatch.setattr(tx, "_common_subsequence", lambda a, b, sweep=tx._common_subsequence: swept.append(a) or sweep(a, b))
    batch = lambda word: pa.array([[f"{word} {n}"] for n in range(40)])
    for _ in range(3):
        assert len(tx.similarities.func(batch("plot of batches"), batch("parcel of batches"))) == 40
    assert len(swept) == 40

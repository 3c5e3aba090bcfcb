"""Embedding links against brute force."""

import numpy as np
from helpers import components

from plotweave.llm import vectors


def brute(rows, cosine=0.9):
    ok = {
        i: np.array(v, float) for i, (_, v) in enumerate(rows)
        if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))
    }
    links = [
        (i, j) for i in ok for j in ok
        if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= cosine
    ]
    part = components(range(len(rows)), links)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        n = sum(i in link for link in links)
        ids = [rows[j][0] for j in part if part[j] == part[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((vec_id, n, low, vec_id is not None and vec_id == low))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.embedding_links(df, **kw).collect()), key=repr)


def cloud(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.3, 0.6], (n, 1))
    return x * rng.choice([0.001, 1.0, 1000.0], (n, 1))


def test_clusters_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 32)  # cells split into many tasks
    monkeypatch.setattr(vectors, "STRIP", 48)
    x = cloud(300, 8, 1).tolist()
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, x[0][:4], x[0][:4]]
    rows = [(i, v) for i, v in enumerate(x + odd + x[:20])] + [(5, x[5]), (None, None)]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<double>, node int, w string")
    assert got(df, pivots=6) == brute(rows)


def test_one_vector_holds_most_rows(spark):
    x = cloud(40, 4, 2).tolist()
    rows = [(i, x[i % 40] if i % 3 else [1.0, 2.0, 3.0, 4.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df) == brute(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    assert got(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")) == [(1, 0, 1, True)]


def test_links_join_rows_step_by_step(spark, monkeypatch):
    rng = np.random.default_rng(3)
    node = rng.permutation(60) * 10
    low, links = node, []
    for _ in range(12):  # a row may be there twice, and reach others over rows of earlier steps
        i, j = rng.integers(0, 60, (2, 4))
        links += zip(node[i].tolist(), node[j].tolist(), strict=True)
        low = vectors._joined(low, i, j)
    part = components(node.tolist(), links)
    assert low.tolist() == [part[x] for x in node.tolist()] and len(set(low.tolist())) > 5
    monkeypatch.setattr(vectors, "STEP", 7)
    monkeypatch.setattr(vectors, "WIDE", 4)  # smaller tiles for wider vectors
    monkeypatch.setattr(vectors, "TILE", 64)
    rows = [(i, v) for i, v in enumerate(cloud(200, 16, 5).tolist())]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=3) == brute(rows)

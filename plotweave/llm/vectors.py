"""Near-duplicate embeddings by an exact metric range join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import cut
from plotweave.operators.components import connected_components

#: Bound of the pivots: a parameter, so the table of pivots does not grow with the data.
PIVOTS = 16
#: Rows of a cell that one task holds, and rows it meets them with; fewer of vectors with over WIDE components.
TILE, STRIP, WIDE = 16384, 16384, 64
#: Rows of a tile that are multiplied at once.
STEP = 128
#: Slack of the boundary test against rounding; it only replicates more.
SLACK = 1e-9


def _usable(vector) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, shorter ones padded with zeros, and their lengths."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(1, keepdims=True)), sizes


def _joined(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``low``, the smallest node that each row is known to reach, after rows i and j are linked."""
    while (apart := low[i] != low[j]).any():
        i, j = i[apart], j[apart]
        high, at = np.unique(np.maximum(low[i], low[j]), return_inverse=True)
        best = high.copy()
        np.minimum.at(best, at, np.minimum(low[i], low[j]))
        place = np.minimum(np.searchsorted(high, low), len(high) - 1)
        low = np.where(high[place] == low, best[place], low)
    return low


def cell_links(vectors: DataFrame, cosine: float, pivots: int = PIVOTS) -> DataFrame:
    """(node, root, n): links of distinct vectors (node, v, w), w counting the rows of each.

    Unit vectors at cosine c are sqrt(2 - 2c) apart, a metric. A vector's home is the cell
    of its nearest pivot. By the triangle inequality a partner of a member of cell i lies
    within r plus the cell's covering radius of pivot i, and at most 2r farther from
    pivot i than from its own pivot. A vector is replicated to the cells of lower number
    that both bounds leave open, so a pair meets in one cell: its members' common home or
    the lower one of two. A cell's members are cut in tiles, and those it meets in strips,
    of bounded size by a hash, so a cell with most of the rows is many tasks. A task
    sums counts per vector and gives each linked vector the smallest one it reaches in the
    task: no pair leaves it.
    """
    r = math.sqrt(2 - 2 * cosine)
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "node long, root long, n long")
    chosen = vectors.orderBy(F.xxhash64(F.lit(7), "v"), "node").limit(pivots).select("v").toArrow()
    p, _ = _units(chosen.column("v"), width)

    def measure(batches):
        for batch in batches:
            x, _ = _units(batch.column("v"), width)
            d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("v"), batch.column("w"), pa.array(d.argmin(1)), pa.array(list(d), pa.list_(pa.float64()))],
                names=["node", "v", "w", "home", "d"],
            )

    element = vectors.schema["v"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        vectors.repartition(tasks).mapInArrow(measure, f"node long, v {element}, w long, home long, d array<double>")
    )
    own = F.element_at("d", (F.col("home") + 1).cast("int"))
    # One row per pivot each.
    radius = {x["home"]: x["far"] for x in placed.groupBy("home").agg(F.max(own).alias("far")).collect()}
    near = [
        F.when(
            (F.col("home") > i)
            & (F.element_at("d", i + 1) <= F.lit(radius[i] + r + SLACK))
            & (F.element_at("d", i + 1) - own <= F.lit(2 * r + SLACK)),
            F.lit(i),
        )
        for i in sorted(radius)
    ]
    cells = F.array_compact(F.array(F.col("home").cast("int"), *near))
    members = cut(placed.select("node", "v", "w", "home", cells.alias("cells")))
    homes = {x["home"]: x["n"] for x in members.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    met = {x["cell"]: x["n"] for x in members.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    tile, strip = (max(1, n * WIDE // max(width, WIDE)) for n in (TILE, STRIP))
    n_tiles = {c: -(-n // tile) for c, n in homes.items()}
    n_strips = {c: -(-n // strip) for c, n in met.items()}

    def of(table: dict, cell) -> F.Column:
        return F.element_at(F.create_map(*[F.lit(x).cast("int") for kv in table.items() for x in kv]), cell.cast("int"))

    h = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    as_home = members.withColumn("cell", F.col("home").cast("int")).select(
        "cell",
        (h % of(n_tiles, F.col("cell"))).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), of(n_strips, F.col("cell")) - 1)).alias("strip"),
        F.lit(0).alias("side"), "node", "v", "w",
    )
    as_met = members.select("*", F.explode("cells").alias("cell")).select(
        "cell",
        F.explode(F.sequence(F.lit(0), of(n_tiles, F.col("cell")) - 1)).alias("tile"),
        (h % of(n_strips, F.col("cell"))).cast("int").alias("strip"),
        F.when(F.col("home") == F.col("cell"), 1).otherwise(2).alias("side"), "node", "v", "w",
    )

    def join(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, w = table.column("node").to_numpy(), table.column("w").to_numpy()
        x, sizes = _units(table.column("v"), width)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        if not len(a) or not len(b):
            return pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        n, low, others = np.zeros(len(node), np.int64), node, x[b].T.copy()
        for at in range(0, len(a), STEP):
            hits = np.flatnonzero(x[a[at : at + STEP]] @ others >= cosine)  # few, of many products
            i, j = a[at + hits // len(b)], b[hits % len(b)]
            linked = (sizes[i] == sizes[j]) & (node[i] != node[j])
            i, j = i[linked], j[linked]
            np.add.at(n, i, w[j])
            other = side[j] == 2  # of one cell, each of two members has the other among those it meets
            np.add.at(n, j[other], w[i[other]])
            low = _joined(low, i, j)
        some = (n > 0) | (low != node)
        return pa.table({"node": node[some], "root": low[some], "n": n[some]})

    tiles = as_home.unionByName(as_met).groupBy("cell", "tile", "strip")
    return tiles.applyInArrow(join, "node long, root long, n long")


def embedding_links(embeddings: DataFrame, cosine: float = 0.9, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings``.

    Equal vectors link with each other and are joined once, with their number. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing,
    and vectors of different lengths do not link. Null ids take no part in component_id
    while another id is there, and a row without id is not kept. Repeated rows count as other vectors, extra columns are
    not read, an empty table gives no rows.
    """
    rows = cut(
        embeddings.select("vec_id", F.when(_usable(F.col("embedding")), F.col("embedding")).alias("v")).select(
            "vec_id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")
        )
    )
    lone = rows.where("v IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    )
    groups = cut(
        rows.where("v IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    found = cut(cell_links(groups.select("node", "v", "w"), cosine, pivots))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = groups.join(counts, "node", "left").join(parts, "node", "left").select(
        "h1", "h2", "low", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("part")
    )
    named = cut(named)
    lowest = named.groupBy("part").agg(F.min("low").alias("component_id"))
    answer = named.join(lowest, "part").select("h1", "h2", "n_links", "component_id")
    linked = rows.where("v IS NOT NULL").select("vec_id", "h1", "h2").join(answer, ["h1", "h2"])
    same = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.select("vec_id", "n_links", "component_id", same.alias("kept")).unionByName(lone)

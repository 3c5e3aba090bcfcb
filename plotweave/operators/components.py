"""Connected components, match groups and conflict hotspots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.session import discard, stored as cut

# Earth radius and neighbourhood of the hotspot clustering.
EARTH_KM = 6371.0088
HOTSPOT_KM = 0.5

LEVELS = 4

_KM_PER_DEGREE = 111.19508023353292


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for edges (u, v); the component is its smallest node.

    Alternates two aggregations: every node links its larger neighbours to the smallest
    one it sees, then its smaller neighbours to the smallest. Chains shorten by a factor
    each round, so the number of rounds grows with the logarithm of the longest chain.
    Minima are partial aggregates, so a node with very many neighbours stays cheap to
    reduce; its join is left to adaptive skew handling.
    """
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        after = cut(small.where("u <> v").distinct())
        settled = _same(links, after)
        discard(links)
        links = after
        if settled:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Equal link sets, by count and by a sum of row hashes."""
    marks = [
        df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
            F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("g"),
        ).first()
        for df in (a, b)
    ]
    return marks[0] == marks[1]


def match_groups(pairs: DataFrame, min_score: int = 70) -> tuple[DataFrame, DataFrame]:
    """(groups, members): groups of features linked by pairs at or above ``min_score``.

    A group is ``clustered`` when at least two pairs agree, ``partial_group`` for a single
    pair. Members are rows (group_id, feature_id), so a group of any size is no list. Where
    pairs carry dataset_a and dataset_b, features are told apart by dataset and id, and
    groups and members also carry group_dataset and dataset_id; group_id is then the id of
    the first feature by dataset, then id.
    """
    keyed = {"dataset_a", "dataset_b"} <= set(pairs.columns)

    def node(side: str) -> Column:
        name = F.col(f"feature_{side}")
        return F.struct(F.col(f"dataset_{side}").alias("dataset_id"), name.alias("feature_id")) if keyed else name

    linked = pairs.where(F.col("score") >= min_score).select(node("a").alias("u"), node("b").alias("v"))
    parts = cut(connected_components(linked))
    links = (
        linked.join(parts, F.col("u") == F.col("node"))
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("pair_count"))
    )
    groups = parts.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("member_count")).join(links, "component")
    status = F.when(F.col("pair_count") >= 2, "clustered").otherwise("partial_group").alias("status")
    if not keyed:
        members = parts.select(F.col("component").alias("group_id"), F.col("node").alias("feature_id"))
        return groups.select(F.col("component").alias("group_id"), "member_count", "pair_count", status), members
    group = [F.col("component.dataset_id").alias("group_dataset"), F.col("component.feature_id").alias("group_id")]
    return groups.select(*group, "member_count", "pair_count", status), parts.select(*group, "node.dataset_id", "node.feature_id")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def _box_km(widest: bool) -> Column:
    """Upper or lower bound of the distance between points of two latitude/longitude boxes."""
    if widest:
        dlat = F.greatest(F.col("n2") - F.col("s1"), F.col("n1") - F.col("s2"))
        dlon = F.greatest(F.col("e2") - F.col("w1"), F.col("e1") - F.col("w2"))
        near_pole = [F.when((F.col(f"s{i}") <= 0) & (F.col(f"n{i}") >= 0), 0.0).otherwise(
            F.least(F.abs(f"s{i}"), F.abs(f"n{i}"))) for i in "12"]
    else:
        dlat = F.greatest(F.col("s2") - F.col("n1"), F.col("s1") - F.col("n2"), F.lit(0.0))
        dlon = F.greatest(F.col("w2") - F.col("e1"), F.col("w1") - F.col("e2"), F.lit(0.0))
        near_pole = [F.greatest(F.abs(f"s{i}"), F.abs(f"n{i}")) for i in "12"]
    c1, c2 = (F.cos(F.radians(v)) for v in near_pole)
    h = F.pow(F.sin(F.radians(dlat) / 2), 2) + c1 * c2 * F.pow(F.sin(F.radians(dlon) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def _parent(index: str, up: int) -> Column:
    """Index of the box ``up`` levels of eight above."""
    return F.floor(F.col(index) / float(8**up))


def proximity_clusters(points: DataFrame, eps_km: float = HOTSPOT_KM) -> DataFrame:
    """Density clusters with one point enough per cluster: components of the ``eps_km`` graph.

    points: (id, lat, lon). Result: (id, cluster), the cluster named by a cell.

    Cells have a diagonal below ``eps_km``, so all points of a cell belong together and no
    pair inside a cell is ever formed. Between neighbouring cells one link is enough: the
    boxes of sixty-four sub-cells decide most, and pairs of sub-cells they leave open are
    divided again, up to LEVELS times. Only points in boxes of centimetres at a distance
    of ``eps_km`` are compared one by one.
    """
    side = eps_km / 2**0.5 / _KM_PER_DEGREE * 0.999
    spots = points.where("lat is not null and lon is not null").select("id", "lat", "lon")
    finest = side / 8**LEVELS
    # Coarser indexes are the finest one divided by powers of two, so parents always agree.
    spots = spots.withColumns({"fi": F.floor(F.col("lat") / finest), "fj": F.floor(F.col("lon") / finest)})
    spots = spots.withColumns({"row": _parent("fi", LEVELS), "column": _parent("fj", LEVELS)})
    spots = cut(spots.withColumn("cell", F.format_string("%d/%d", "row", "column")))
    cells = spots.groupBy("cell", "row", "column").agg(F.count(F.lit(1)).alias("n"))

    # Longitude cells shrink towards the poles, so the reach in columns depends on the row.
    shrink = F.greatest(F.cos(F.radians(F.least(F.greatest(
        F.abs((F.col("row") - 2) * side), F.abs((F.col("row") + 3) * side)), F.lit(90.0)))), F.lit(1e-6))
    turn = int(360 / side)
    reach = F.least(F.ceil(F.lit(1.5) / shrink) + 1, F.lit(turn // 2))
    hops = (
        cells.withColumn("dr", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .withColumn("dc", F.explode(F.sequence(-reach, reach)))
        .where("dr > 0 or dc > 0")
        .select(
            F.col("cell").alias("cell1"), (F.col("row") + F.col("dr")).alias("row"), (F.col("column") + F.col("dc")).alias("column")
        )
    )
    wrapped = F.col("column") - F.lit(turn) * F.floor((F.col("column") + F.lit(turn / 2)) / F.lit(turn))
    hops = hops.withColumn("column", F.explode(F.array_distinct(F.array("column", wrapped))))
    near = hops.join(cells.select("row", "column", F.col("cell").alias("cell2")), ["row", "column"])
    near = near.where("cell1 <> cell2").select("cell1", "cell2").distinct()

    def boxes(i: str, up: int) -> DataFrame:
        place = [F.col("cell").alias(f"cell{i}"), _parent("fi", up).alias(f"i{i}"), _parent("fj", up).alias(f"j{i}")]
        return spots.groupBy(*place).agg(
            F.min("lat").alias(f"s{i}"), F.max("lat").alias(f"n{i}"), F.min("lon").alias(f"w{i}"), F.max("lon").alias(f"e{i}")
        )

    found, ends = [], ["cell1", "i1", "j1", "cell2", "i2", "j2"]
    for up in range(LEVELS - 1, -1, -1):
        duos = near
        for i in "12":
            inner = boxes(i, up)
            if up < LEVELS - 1:
                inner = inner.withColumns({f"p{i}": _parent(f"i{i}", 1), f"q{i}": _parent(f"j{i}", 1)})
                duos = duos.withColumnsRenamed({f"i{i}": f"p{i}", f"j{i}": f"q{i}"}).join(inner, [f"cell{i}", f"p{i}", f"q{i}"])
            else:
                duos = duos.join(inner, f"cell{i}")
        duos = duos.withColumn("sure", _box_km(True) <= eps_km).withColumn("maybe", _box_km(False) <= eps_km + 1e-9)
        duos = cut(duos.where("sure or maybe").select(*ends, "sure"))
        linked = duos.where("sure").select("cell1", "cell2").distinct()
        found.append(linked)
        near = cut(duos.join(linked, ["cell1", "cell2"], "left_anti").select(*ends))
        if near.limit(1).count() == 0:
            break

    def distinct_points(i: str) -> DataFrame:
        place = [F.col("cell").alias(f"cell{i}"), F.col("fi").alias(f"i{i}"), F.col("fj").alias(f"j{i}")]
        return spots.select(*place, F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}")).distinct()

    by_point = (
        near.join(distinct_points("1"), ["cell1", "i1", "j1"])
        .join(distinct_points("2"), ["cell2", "i2", "j2"])
        .where(haversine_km("lat1", "lon1", "lat2", "lon2") <= eps_km)
        .select("cell1", "cell2")
        .distinct()
    )
    links = reduce(DataFrame.unionByName, found, by_point).select(F.col("cell1").alias("u"), F.col("cell2").alias("v"))
    parts = connected_components(links)
    return spots.join(parts, F.col("cell") == F.col("node"), "left").select(
        "id", F.coalesce("component", "cell").alias("cluster")
    )

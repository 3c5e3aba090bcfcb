"""Literal cases of the engine: scoring, rules, vocabulary, validation, topology."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import check
from plotweave.functions import geometry as gm
from plotweave.functions import kernels as k
from plotweave.functions import outline as ol
from plotweave.functions import ragged as rg
from plotweave.functions import standards as st
from plotweave.functions import text as tx
from plotweave.functions import ulpin as ul
from plotweave.operators import components as cc
from plotweave.operators import encroachment as en
from plotweave.operators import harmonize as hz
from plotweave.operators import model as md
from plotweave.operators import reconcile as rc
from plotweave.operators import scoring as sc
from plotweave.operators import spatial_join as sj
from plotweave.operators import standardize as sd
from plotweave.operators import topology as tp
from plotweave.operators import union as un
from plotweave.operators import validate as vd
from plotweave.plans import matching as mt
from plotweave.session import cut
from plotweave.sources import fixtures as fx
from plotweave.sources import readers as rd


def rects(spark, rows, extra="idx long, feature_id string"):
    names = [p.split()[0] for p in extra.split(",")]
    df = spark.createDataFrame(rows, f"{extra}, x0 double, y0 double, x1 double, y1 double")
    return df.select(*names, gm.rect("x0", "y0", "x1", "y1").alias("geom"))


def records(spark, a, b):
    schema = """feature_id string, x0 double, x1 double, area double, land_use string, source_reliability double,
        ulpin string, khasra_no string"""
    out = []
    for r in (a, b):
        df = spark.createDataFrame([r], schema)
        df = df.withColumn("geom", F.when(F.col("x0").isNotNull(), gm.rect("x0", F.lit(28.0), "x1", F.lit(28.001))))
        out.append(df)
    return out


def score_pair(spark, a, b):
    left, right = (sc.prepare(df) for df in records(spark, a, b))
    pairs = spark.createDataFrame([(a[0], b[0])], "feature_a string, feature_b string")
    return sc.score(sc.pair_rows(pairs, left, right), md.default_model(spark)).first()


def test_identical_pair_matches(spark):
    r = score_pair(spark, ("A", 77.0, 77.001, 100.0, "Residential", 90.0, None, None), ("B", 77.0, 77.001, 100.0, "Residential", 90.0, None, None))
    assert r.score >= 95 and r.status == "matched" and r.matched_attributes == ["land_use"]


def test_same_shape_other_attributes_goes_to_review(spark):
    r = score_pair(spark, ("A", 77.0, 77.001, 50.0, "Industrial", 80.0, None, None), ("B", 77.0, 77.001, 100.0, "Residential", 80.0, None, None))
    assert 70 <= r.score < 90 and r.status == "review" and "land_use" in r.differing_attributes


def test_ids_only_scores_zero(spark):
    r = score_pair(spark, ("A", None, None, None, None, None, None, None), ("B", None, None, None, None, None, None, None))
    assert r.score == 0 and r.status == "unmatched"


def test_equal_identifiers_decide(spark):
    r = score_pair(spark, ("A", 77.0, 77.001, 10.0, None, 90.0, "ABCDEFGHJK1234", "12/4"), ("B", 77.0, 77.001, 10.0, None, 90.0, "ABCDEFGHJK1234", "12/4"))
    assert r.score >= 95 and {"ulpin", "khasra_no"} <= set(r.matched_attributes)


def test_thresholds(spark):
    rows = spark.createDataFrame([(90,), (89,), (70,), (69,)], "s int").select(sc.classify("s").alias("c")).collect()
    assert [r.c for r in rows] == ["matched", "review", "review", "unmatched"]
    with pytest.raises(ValueError):
        sc.classify("s", 60, 70)


def test_classifier_low_vector(spark):
    row = spark.createDataFrame([(0.05, 0.1, 0.1, 0.1, 0.05, 0.8, 0.8)], ", ".join(f"{f} double" for f in md.FEATURES))
    r = md.predict_pairs(md.default_model(spark), row).first()
    assert r.mlp_score < 60 and r.mlp_class == "unmatched"


def test_area_texts(spark):
    rows = [("2 बीघा",), ("1 Bigha 5 Biswa",), ("4 Guntha",), ("2 Kanal",), ("1200",), ("none",), (None,), ("10 sq ft",)]
    got = [tuple(r.parsed) for r in st.area_to_m2(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert [g[0] for g in got] == [5058.58, 3161.61, 404.68, 1011.71, 1200.0, None, None, 10.0]
    assert [g[1] for g in got][4:] == ["raw_numeric", "unparseable", "unknown", "raw_numeric"]


def test_hindi_properties(spark):
    props = {"खसरा": "102/4", "खाता": "KH-882", "मालिक": "Ram", "किस्म ज़मीन": "Agricultural", "रकबा": "2 बीघा", "मौजा": "Rampur", "zzqq": "x"}
    df = spark.createDataFrame([(props,)], "properties map<string,string>")
    r = sd.map_fields(df).first()
    assert r.mapped["parcel_id"] == "102/4" and r.mapped["khata_number"] == "KH-882" and r.mapped["owner"] == "Ram"
    assert r.mapped["land_use"] == "Agricultural" and r.mapped["village"] == "Rampur"
    assert r.area_sqm == 5058.58 and r.rest == {"zzqq": "x"}


def test_standardize_unknown_id(spark):
    df = spark.createDataFrame([(1, 0, {"landuse": "Farm", "qqq": "1"}), (1, 1, {"plot_no": "P7", "owner_name": "S"})], "dataset_id int, feature_index int, properties map<string,string>")
    df = df.withColumn("geom", gm.rect(F.lit(77.0), F.lit(28.0), F.lit(77.001), F.lit(28.001)))
    features, unmapped = sd.standardize(df, "cadastral")
    got = {r.feature_index: r for r in features.collect()}
    assert got[0].feature_id == "unknown-0" and got[0].attributes["land_use"] == "Farm"
    assert got[1].feature_id == "P7" and got[1].attributes["owner"] == "S" and len(got[1].attributes["ulpin"]) == 14
    assert unmapped.collect()[0].unmapped_fields == ["qqq"]


def test_ulpin_round_trip(spark):
    df = ul.with_decoded(ul.with_ulpin(spark.createDataFrame([(28.6139, 77.209)], "lat double, lon double"), "lat", "lon"), "ulpin")
    r = df.first()
    assert abs(r.decoded.latitude - 28.6139) < 0.001 and abs(r.decoded.longitude - 77.209) < 0.001 and r.decoded.valid
    bad = spark.createDataFrame([("12345678901234",), ("short",), (None,)], "u string").select(ul.ulpin_valid("u").alias("v"))
    assert [r.v for r in bad.collect()] == [False, False, False]


def test_text_outside_ascii(spark):
    df = spark.createDataFrame([("Straße №5",), ("खसरा नं",), ("ＡＢＣ",)], "t string")
    assert [r.n for r in df.select(tx.normalize_text("t").alias("n")).collect()] == ["strasse no5", "खसर न", "abc"]


def test_similarity_is_insert_delete(spark):
    df = spark.createDataFrame([("kitten", "sitting")], "a string, b string").select(tx.similarity("a", "b").alias("s"))
    assert df.first().s == pytest.approx(100 * 8 / 13)


def test_inverted_point_in_csv(spark):
    df = spark.createDataFrame([("P-1", "28.6", "77.2"), ("P-2", "77.2", "28.6")], "parcel_id string, latitude string, longitude string")
    got = [r.geom.parts[0].shell[0] for r in rd.points_from(df).orderBy("parcel_id").collect()]
    assert [(p.x, p.y) for p in got] == [(77.2, 28.6)] * 2


def defects(spark):
    texts = ["POLYGON((5 5,6 5,6 6,5 6,5 5))", None, "POLYGON((0 0,2 2,2 0,0 2,0 0))"]
    def ring(t):
        return [tuple(map(float, p.split())) for p in t[9:-2].split(",")] if t else []
    rows = [(1, i, ("Polygon", [(ring(t), [])])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"dataset_id int, feature_index int, geom {gm.GEOMETRY}")


def test_validate_and_repair(spark):
    df = defects(spark)
    issues = {r.feature_index: r.code for r in vd.validate(df).collect()}
    assert issues == {1: "empty_geometry", 2: "invalid_geometry"}
    kept, dropped = vd.repair(df)
    areas = {r.feature_index: (r.repaired, r.a) for r in kept.withColumn("a", gm.area("geom")).collect()}
    assert areas == {0: (False, 1.0), 2: (True, pytest.approx(2.0))}
    assert [(r.feature_index, r.code) for r in dropped.collect()] == [(1, "unrepairable_geometry")]


def test_recommendations(spark):
    rows = [
        (47, "area", "medium", 89, 95.0, 80.0), (1, "duplicate", "high", None, 95.0, 80.0),
        (2, "temporal", "low", None, 95.0, 80.0), (3, "attribute", "medium", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, type string, severity string, score int, rel_a double, rel_b double")
    got = {r.id: r for r in rc.recommend(df.withColumns({"has_a": F.lit(True), "has_b": F.lit(True)})).collect()}
    assert (got[47].action, got[47].confidence, got[47].reason) == ("prefer_source_a", 89, "Source A has the higher reliability score")
    assert [got[i].action for i in (1, 2, 3)] == ["manual_review_required", "flag_real_world_change", "merge_attributes"]
    assert [got[i].confidence for i in (1, 2, 3)] == [90, 70, 80]


def test_review_aliases(spark):
    given = ["accept", " APPROVED", "reject", "REJECTED", "flag", "edit", "later"]
    df = spark.createDataFrame([(g,) for g in given], "d string").select(rc.canonical_decision("d").alias("c"))
    assert [r.c for r in df.collect()] == ["APPROVED"] * 2 + ["REJECTED"] * 2 + ["FLAGGED"] * 2 + ["LATER"]


def test_overlap_found_and_resolved(spark):
    layer = rects(spark, [(0, "a", 77.0, 28.0, 77.0001, 28.0001), (1, "b", 77.00009, 28.0, 77.0002, 28.0001)])
    assert tp.detect_overlaps(layer).count() == 1
    fixed, fixes = tp.resolve_overlaps(layer)
    assert fixes.count() == 1 and tp.detect_overlaps(fixed).count() == 0


def test_snap_pair(spark):
    layer = rects(spark, [(0, "a", 77.0, 28.0, 77.001, 28.001), (1, "b", 77.00102, 28.0, 77.002, 28.001)])
    snapped, fixes = tp.snap(layer)
    assert [r.feature_id for r in fixes.collect()] == ["a"]
    assert snapped.where("idx = 0").select(gm.bbox("geom").alias("b")).first().b.maxx == 77.00102


def test_snap_to_reference_inserts_vertex(spark):
    target = rects(spark, [(0, "a", 77.0, 28.0, 77.001, 28.001)])
    ref = rects(spark, [(5, "r", 77.00002, 28.00099, 77.0005, 28.002)])
    snapped, fixes = tp.snap(target, ref)
    assert fixes.count() == 1
    assert snapped.select(gm.n_vertices("geom").alias("n")).first().n > 5


def test_corridor_buffer(spark):
    corridor = spark.createDataFrame([(1, 77.0, 28.0, 77.01, 28.0)], "corridor_id int, xa double, ya double, xb double, yb double")
    corridor = corridor.select("corridor_id", gm.line(gm.point("xa", "ya"), gm.point("xb", "yb")).alias("geom"))
    parcels = rects(spark, [(0, "near", 77.002, 28.0001, 77.003, 28.001), (1, "far", 77.002, 28.5, 77.003, 28.501)])
    got = en.row_breaches(corridor, parcels, 30.0, outline=True).collect()
    assert [r.parcel_feature for r in got] == ["near"] and got[0].breach_area_sqm > 0 and got[0].geom is not None


def test_encroachment_wide_parcel_is_planar(spark):
    parcel = rects(spark, [(0, "P", 0.0, 0.0, 10.0, 10.0)])
    drone = rects(spark, [(0, "D", 8.0, 2.0, 12.0, 4.0)])
    r = en.encroachments(parcel, drone, outline=True).first()
    assert r.status == "flagged" and r.severity == "critical" and r.encroachment_area_sqm > 0


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    got = cc.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.node)
    assert by == {0: set(range(41)), 100: set(range(100, 160)), 200: {200, 201}}
    assert len(got) == 41 + 60 + 2


def test_copies_do_not_change_candidates(spark):
    """A heap of copies in B: the nearest ten by id, exactly as brute force gives."""
    a = gm.with_stats(rects(spark, [(i, f"a{i:02d}", 77.0 + i * 1e-4, 28.0, 77.001 + i * 1e-4, 28.001) for i in range(5)]))
    b = gm.with_stats(rects(spark, [(i, f"b{i:03d}", 77.0, 28.0, 77.001, 28.001) for i in range(60)] + [(99, "z", 77.0002, 28.0, 77.0012, 28.001)]))
    got = {}
    assert sj.candidates(a, b).count() == 5 * 61  # all of them unless a cap is asked for
    for r in sj.candidates(a, b, cap=10).collect():
        got.setdefault(r.feature_a, set()).add(r.feature_b)
    copies = {f"b{i:03d}" for i in range(10)}
    first9 = {f"b{i:03d}" for i in range(9)}
    assert got["a00"] == copies and got["a04"] == first9 | {"z"}


def test_one_huge_feature_in_the_grid(spark):
    rows = [(i, f"s{i}", 77 + (i % 20) * 0.001, 28 + (i // 20) * 0.001, 77.0004 + (i % 20) * 0.001, 28.0004 + (i // 20) * 0.001) for i in range(200)]
    small, big = rects(spark, rows), rects(spark, [(0, "big", 70.0, 20.0, 90.0, 40.0)])
    assert sj.overlay_pairs(small, big).count() == 200 and sj.overlay_pairs(big, small).count() == 200


def star(rng, n=9):
    t = np.sort([rng.uniform(0, 2 * math.pi) for _ in range(n)])
    r = np.array([rng.uniform(0.3, 1.0) for _ in range(n)])
    pts = np.column_stack([r * np.cos(t), r * np.sin(t)]) + [rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)]
    return np.concatenate([pts, pts[:1]])


def test_shared_area_agrees_with_outlines():
    rng = random.Random(3)
    a, b = [star(rng) for _ in range(30)], [star(rng) for _ in range(30)]
    to = lambda rings: rg.geometry_array([rg.to_geometry([(r, [])]) for r in rings])
    kernel = k._intersection(rg.edges(to(a)), rg.edges(to(b)))
    rule = lambda w: (w[0] > 0) & (w[1] > 0)
    for area, p, q in zip(kernel, a, b):
        parts = ol.regions([ol.oriented([(p, False)]), ol.oriented([(q, False)])], rule)
        assert area == pytest.approx(sum(ol.ring_area(s) + sum(map(ol.ring_area, hs)) for s, hs in parts), abs=1e-9)


def test_distributed_union_agrees_with_local_union(spark):
    rng = random.Random(5)
    stars = [star(rng) for _ in range(12)]
    records = [(1, rg.to_geometry([(r, [])])) for r in stars]
    df = spark.createDataFrame(records, f"g int, geom {gm.GEOMETRY}")
    whole = un.dissolve(df, "g").select(gm.area("geom").alias("a")).first().a
    local = ol.regions([[r for s in stars for r in ol.oriented([(s, False)])]], lambda w: w[0] > 0)
    assert whole == pytest.approx(sum(ol.ring_area(s) + sum(map(ol.ring_area, hs)) for s, hs in local), abs=1e-8)


def patches(cells):
    """Sizes of the groups of cells that share sides."""
    left, sizes = set(cells), []
    while left:
        heap, n = [left.pop()], 0
        while heap:
            i, j = heap.pop()
            n += 1
            for near in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if near in left:
                    left.remove(near)
                    heap.append(near)
        sizes.append(n)
    return sorted(sizes)


def test_union_as_ring_rows_agrees_with_patches_of_cells(spark):
    """Holes in islands in holes, shells beside holes in their boxes, and rings that touch in corners."""
    side, rng = 0.001, random.Random(8)
    frame = lambda a, b: {(i, j) for i in range(a, b + 1) for j in range(a, b + 1) if i in (a, b) or j in (a, b)}
    bay = {(i, 14) for i in range(24)} | {(0, j) for j in range(14, 24)} | {(23, j) for j in range(14, 24)}
    inlet = {(i + 8, j + 16) for i, j in frame(0, 4)} | {(10, 18)}
    groups = [
        frame(0, 12) | frame(2, 10) | frame(4, 8) | {(6, 6)} | bay | inlet,
        *({(i, j) for i in range(14) for j in range(14) if rng.random() < share} for share in (0.45, 0.65, 0.8)),
        {(3, 3)},
    ]
    rows = [(g, i * side, j * side, (i + 1) * side, (j + 1) * side) for g, cells in enumerate(groups) for i, j in sorted(cells)]
    layer = spark.createDataFrame(rows * 2, "g int, x0 double, y0 double, x1 double, y1 double").select("g", gm.rect("x0", "y0", "x1", "y1").alias("geom"))
    parts = [(r.g, r.a, r.units) for r in un.dissolved_parts(layer, "g").select("g", gm.area("geom").alias("a"), F.col("area_units").alias("units")).collect()]
    for g, cells in enumerate(groups):
        assert sorted(round(a / side**2) for k, a, _ in parts if k == g) == patches(cells)
    assert all(a == pytest.approx(units, abs=1e-12) for _, a, units in parts)
    whole = {r.g: (r.n, r.kind) for r in un.dissolve(layer, "g").select("g", F.size("geom.parts").alias("n"), F.col("geom.type").alias("kind")).collect()}
    assert whole == {g: (len(patches(c)), "MultiPolygon" if len(patches(c)) > 1 else "Polygon") for g, c in enumerate(groups)}
    assert un.dissolved_parts(layer.where("false"), "g").count() == 0


def test_hotspots_agree_with_brute_force(spark):
    rng = random.Random(11)
    pts = [(i, 60 + rng.uniform(0, 0.05), 10 + rng.uniform(0, 0.1)) for i in range(150)] + [(500 + i, 60.02, 10.05) for i in range(50)]
    got = {r.id: r.cluster for r in cc.proximity_clusters(spark.createDataFrame(pts, "id long, lat double, lon double")).collect()}

    def km(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    parent = {p[0]: p[0] for p in pts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(pts):
        for q in pts[:i]:
            if km(p, q) <= 0.5:
                parent[find(p[0])] = find(q[0])
    groups = lambda label: {frozenset(i for i in got if label(i) == c) for c in {label(i) for i in got}}
    assert groups(got.get) == groups(find)


def test_copies_lose_a_shared_piece_once(spark):
    heap = [(i, f"c{i}", 77.0, 28.0, 77.0001, 28.0001) for i in range(0, 40, 2)]
    other = [(5, "x", 77.00009, 28.0, 77.0002, 28.0001), (99, "y", 77.00009, 28.0, 77.0002, 28.0001)]
    fixed, fixes = tp.resolve_overlaps(rects(spark, heap + other))
    got = sorted((r.idx, r.description.rsplit(" ", 1)[1]) for r in fixes.collect())
    later = [(i, "x") for i, *_ in heap if i > 5]
    assert got == sorted([(5, "c0"), (99, "c0"), *later])
    width = {r.idx: r.b.maxx - r.b.minx for r in fixed.select("idx", gm.bbox("geom").alias("b")).collect()}
    assert width[0] == pytest.approx(1e-4) and width[5] == pytest.approx(1e-4) and width[38] == pytest.approx(9e-5)


def in_order(boxes, limit):
    """Pair-by-pair loop over axis-parallel boxes, as sets of cells of a grid of 1e-5 degrees."""
    cells = [{(x, y) for x in range(x0, x1) for y in range(y0, y1)} for x0, y0, x1, y1 in boxes]
    fixes = []
    for i in range(len(cells)):
        for j in range(i + 1, len(cells)):
            both = cells[i] & cells[j]
            if both and len(both) <= limit and cells[j] - both:
                cells[j] = cells[j] - both
                fixes.append((j, str(i), len(both)))
    return cells, sorted(fixes)


def check_order(spark, boxes, limit=80):
    unit = 1e-10 * gm._FIXED_SCALE
    layer = rects(spark, [(i, str(i), *[v * 1e-5 for v in b]) for i, b in enumerate(boxes)])
    fixed, fixes = tp.resolve_overlaps_in_order(layer, (limit + 0.5) * unit)
    cells, want = in_order(boxes, limit)
    got = sorted((r.idx, r.description.rsplit(" ", 1)[1], round(r.delta_area_sqm / unit)) for r in fixes.collect())
    assert got == want
    size = {r.idx: round(r.a / unit) for r in fixed.select("idx", gm.deg2_to_m2(gm.area("geom")).alias("a")).collect()}
    assert size == {i: len(c) for i, c in enumerate(cells)}


def test_overlaps_in_order_equal_the_pair_loop(spark):
    rng = np.random.default_rng(4)
    boxes = []
    for x, y, w, h in rng.integers([0, 0, 3, 3], [60, 60, 14, 14], (24, 4)).tolist():
        boxes.append((x, y, x + w, y + h))
    check_order(spark, boxes + boxes[:4])


@pytest.mark.parametrize("boxes", [
    [(0, 0, 10, 2), (8, 0, 20, 2), (6, 0, 30, 2)],  # the second has lost what the third shares with both
    [(0, 0, 10, 10), (9, 0, 20, 10), (9, 0, 19, 10), (18, 0, 40, 10)],
    [(0, 0, 5, 5), (6, 0, 11, 5), (0, 0, 11, 5)], [(0, 0, 5, 5), (5, 0, 10, 5), (0, 0, 10, 5)],  # covered in full by two
    [(0, 0, 10, 10), (9, 0, 20, 10), (0, 0, 10, 10), (9, 0, 20, 10)],  # heaps of copies
    [(0, 0, 3, 3)], [(0, 0, 20, 20), (0, 0, 20, 20)],
])
def test_chains_of_overlaps(spark, boxes):
    check_order(spark, boxes)


def test_t_junction_closes_in_either_order(spark):
    """The corner of one parcel near the long edge of another is inserted there, whichever comes first."""
    long_one = ("long", 77.0, 28.0, 77.002, 28.001)
    short_one = ("short", 77.0005, 28.00102, 77.0015, 28.002)
    for order in ([long_one, short_one], [short_one, long_one]):
        layer = rects(spark, [(i, *r) for i, r in enumerate(order)])
        snapped, fixes = tp.snap(layer)
        n = {r.feature_id: r.n for r in snapped.select("feature_id", gm.n_vertices("geom").alias("n")).collect()}
        assert n["long"] == 7 and [r.feature_id for r in fixes.collect()] == ["long"]


def test_numbers_of_all_kinds(spark):
    rows = spark.sql("SELECT true AS b, '12F' AS f, '3d' AS d, ' -1.5e3 ' AS t, '.5' AS h, '' AS e, 7 AS i, CAST(null AS STRING) AS n")
    got = rows.select(*[tx.numeric_value(F.col(c)).alias(c) for c in rows.columns]).first().asDict()
    assert got == {"b": None, "f": None, "d": None, "t": -1500.0, "h": 0.5, "e": None, "i": 7.0, "n": None}


def test_area_digits_and_spaces_of_all_scripts(spark):
    rows = spark.createDataFrame([(t,) for t in ("૨ bigha", "২ bigha", "2\u00a0bigha", "２ bigha", "\U0001d7d0 bigha")], "a string")
    got = {r.parsed.m2 for r in st.area_to_m2(rows, "a").collect()}
    assert len(got) == 1 and got.pop() > 1000


def test_holes_and_parts_must_lie_where_they_belong():
    def square(x, y, s):
        return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]

    def shape(*parts):
        return {"type": "MultiPolygon", "parts": [{"shell": square(*p[0]), "holes": [square(*h) for h in p[1:]]} for p in parts]}

    cases = [
        (shape([(0, 0, 10), (2, 2, 2)]), True),
        (shape([(0, 0, 10), (20, 2, 2)]), False),  # hole outside its shell
        (shape([(0, 0, 10), (2, 2, 6), (3, 3, 1)]), False),  # hole in a hole
        (shape([(0, 0, 10)], [(2, 2, 2)]), False),  # part in a part
        (shape([(0, 0, 10), (2, 2, 6)], [(3, 3, 1)]), True),  # part in the hole of another
        (shape([(0, 0, 1)], [(5, 5, 1)]), True),
        (shape([(0, 0, 1)]), True),
    ]
    assert k._valid_rows(rg.geometry_array([c for c, _ in cases])).tolist() == [ok for _, ok in cases]


def test_collections_keep_their_polygons(spark, tmp_path):
    import json

    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]
    members = [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": square(0)}, {"type": "MultiPolygon", "coordinates": [square(2), square(4)]}]
    feature = lambda g: json.dumps({"type": "Feature", "properties": {"n": 1}, "geometry": g})
    lines = [feature({"type": "GeometryCollection", "geometries": m}) for m in (members, members[:1], [])]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = [(r.t, r.n) for r in rd.read_geojson_lines(spark, str(tmp_path / "a.json")).select("geom.type", F.size("geom.parts").alias("n")).toDF("t", "n").collect()]
    assert got[:2] == [("MultiPolygon", 3), ("MultiPoint", 1)] and not (got[2][1] or 0) > 0
    wkt = "GEOMETRYCOLLECTION (POINT (1 2), POLYGON ((0 0, 1 0, 1 1E0, 0 1, 0 0)), MULTIPOLYGON (((2 0, 3 0, 3 1, 2 1, 2 0)), ((4 0, 5 0, 5 1, 4 1, 4 0))))"
    row = rd.from_wkt(spark.createDataFrame([(wkt,)], "w string"), "w").select("geom.type", F.size("geom.parts")).first()
    assert tuple(row) == ("MultiPolygon", 3)


def test_kml_multigeometry_and_data(spark, tmp_path):
    ring = "<outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,1 0,0</coordinates></LinearRing></outerBoundaryIs>"
    data = "<ExtendedData><Data name='owner'><value>A</value></Data><Data name='zone'><value>R1</value></Data></ExtendedData>"
    (tmp_path / "a.kml").write_text(
        f"<kml><Document><Placemark><name>m</name>{data}<MultiGeometry><Polygon>{ring}</Polygon><Polygon>{ring}</Polygon></MultiGeometry></Placemark>"
        f"<Placemark><name>p</name><Point><coordinates>1,2,0</coordinates></Point></Placemark></Document></kml>"
    )
    (tmp_path / "b.kml").write_text("<kml><Document></Document></kml>")
    got = {r.name: (r.properties, r.geom.type, len(r.geom.parts)) for r in rd.read_kml(spark, str(tmp_path)).collect()}
    assert got == {"m": ({"owner": "A", "zone": "R1"}, "MultiPolygon", 2), "p": ({}, "Point", 1)}
    assert [r.path.rsplit("/", 1)[1] for r in rd.kml_issues(spark, str(tmp_path)).collect()] == ["b.kml"]


def test_tables_without_coordinates_are_issues(spark, tmp_path):
    for name, text in (("a.csv", "id,Latitude,lon\n1,2,3\n"), ("b.csv", 'id,"WKT"\n1,x\n'), ("c.csv", "id,name\n1,x\n")):
        (tmp_path / name).write_text(text)
    assert sorted(r.path.rsplit("/", 1)[1] for r in rd.table_issues(spark, str(tmp_path)).collect()) == ["c.csv"]
    assert rd.read_points(spark, str(tmp_path / "c.csv")).count() == 0


def test_trace_of_parcels(spark):
    """Chains, splits, circles met or joined, null and repeated steps, and parcels nobody knows."""
    steps = [("a", "b"), ("b", "c"), ("b", "c"), ("c", "d"), ("a", "s"), ("x", "y"), ("y", "x"), ("w", "x"), ("w", "v"), (None, "a"), ("d", None), ("o", "o")]
    lineage = spark.createDataFrame([(*s, 1) for s in steps], "source_id string, parcel_id string, root int")
    wanted = spark.createDataFrame([(p,) for p in ["a", "c", "d", "x", "w", "o", "z", "a", None]], "parcel_id string")
    got = {tuple(r) for r in hz.trace_parcels(wanted, lineage).collect()}
    assert got == {("a", "d", False), ("a", "s", False), ("c", "d", False), ("d", "d", False), ("x", None, True), ("w", "v", True), ("o", None, True), ("z", "z", False)}
    assert hz.trace_parcels(wanted.where("false"), lineage).count() == 0
    assert hz.trace_parcels(wanted, lineage.where("false")).count() == 7


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_on_cut_tables_are_merge_joins(spark):
    """Regular coordinates pack a hundred times, so a table broadcast by the size of its files may not fit the driver."""
    ids = cut(spark.range(2000).select("id", F.struct(*[(F.col("id") * 0.001).alias(n) for n in ("minx", "miny", "maxx", "maxy")]).alias("box")))
    left, right = ids.select("id", F.col("box").alias("lbox")), ids.select(F.col("id").alias("other"), F.col("box").alias("rbox"))
    met = sj.grid_join(left, right, ready=True)
    assert "BroadcastHashJoin" not in _plan(met) and "SortMergeJoin" in _plan(met)
    assert "BroadcastHashJoin" not in _plan(ids.join(ids.select("id").distinct(), "id", "left_anti"))
    assert met.where("id = other").count() == 2000


def test_pairs_meet_their_features_in_merge_joins(spark):
    """Layers with texts and shapes are larger than their files by far; the driver need not hold them."""
    assert "BroadcastHashJoin" not in _plan(mt.near_rows(spark, "/root/testdata/sf0.001"))


def test_registry_and_bridge_join_layers_by_merging(spark):
    for name in ("s9_registry_export", "r5_contract_bridge", "j14_expected_absence"):
        assert "BroadcastHashJoin" not in _plan(entry_module.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_rows_of_layers_are_dealt_out(spark):
    """A small file is one task's; the work its shapes make is not."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in fx.SPREAD:
        assert fx.view(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() == tasks


def test_coverage_counts_buildings_on_one_place_once(spark, tmp_path):
    """Moved buildings of the second survey lie on others as soon as keys reach 150,000."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS c_custkey FROM (SELECT unnest(range(100)) AS k UNION ALL SELECT unnest(range(150000, 150100))) t) TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    df = entry_module.queries()["g4_coverage"](spark, str(tmp_path))
    assert check.compare(df, con, entry_module.oracle_sql()["g4_coverage"]) is None
    assert {r.dataset_id: r.area for r in df.collect()} == {1: 32.0, 2: 30.08}


def test_outlines_of_many_rows_at_once_are_those_of_each_row():
    """Rows share no nodes, whatever they hold: bowties, holes, several parts, nothing."""
    rnd = random.Random(3)

    def ring(n):
        points = [{"x": 77 + rnd.randrange(9) * 0.0005, "y": 28 + rnd.randrange(9) * 0.0005} for _ in range(n)]
        return points + points[:1]

    def geom():
        parts = [{"shell": ring(rnd.randrange(3, 9)), "holes": [ring(4) for _ in range(rnd.randrange(3))]} for _ in range(rnd.randrange(3))]
        return {"type": "MultiPolygon", "parts": parts} if rnd.random() < 0.9 else None

    rule = lambda w: (w[0] > 0) & (w[1] <= 0)
    a, b = (pa.array([geom() for _ in range(300)], type=rg.GEOMETRY_T) for _ in range(2))
    together = ol.row_regions(*rg.segments([a, b], True), 300, 2, rule)
    alone = [ol.regions([ol.oriented(x), ol.oriented(y)], rule) for x, y in zip(rg.row_rings(a), rg.row_rings(b))]
    assert [rg.to_geometry(r) for r in together] == [rg.to_geometry(r) for r in alone]
    assert sum(map(bool, alone)) > 100


def test_snap_rebuilds_only_features_that_change(spark, monkeypatch):
    square = lambda i, x, y: (i, f"s{i}", x, y, x + 0.25, y + 0.25)
    layer = rects(spark, [square(i, 77 + i % 4 * 0.25, 28 + i // 4 * 0.25) for i in range(16)] + [square(16, 80.0, 28.0), square(17, 80.25001, 28.0)])
    rebuilt = []
    monkeypatch.setattr(tp, "_rebuild", lambda rows, rebuild=tp._rebuild: rebuilt.append(rows.select("idx").distinct().count()) or rebuild(rows))
    snapped, fixes = tp.snap(layer)
    assert rebuilt == [1] and [r.feature_id for r in fixes.collect()] == ["s16"]  # corners that neighbours share stay where they are
    assert snapped.count() == 18


def test_ledger_is_written_without_audits(spark, monkeypatch):
    """Gaps are searched once, by the step that fills them: the audits before and after do not reach the ledger."""
    searched = []
    monkeypatch.setattr(tp, "detect_gaps", lambda *args, search=tp.detect_gaps: searched.append(1) or search(*args))
    layer = rects(spark, [(0, "a", 77.0, 28.0, 77.25, 28.25), (1, "b", 77.2499999, 28.0, 77.5, 28.25), (2, "c", 78.0, 28.0, 78.25, 28.25)])
    ledger = lambda fixes: sorted((r.fix_type, r.idx, r.delta_area_sqm) for r in fixes.collect())
    audited = ledger(tp.correct_topology(layer, tol=1e-9, max_overlap_m2=1e6)[2])
    assert len(searched) == 3 and [r[:2] for r in audited] == [("overlap_merge", 1), ("snap", 0), ("snap", 1)]
    assert ledger(tp.fix_topology(layer, tol=1e-9, max_overlap_m2=1e6)[1]) == audited and len(searched) == 4
    assert entry_module.queries()["o10_fix_ledger"](spark, "/root/testdata/sf0.001").count() == 2 and len(searched) == 5


def test_vertices_on_one_spot_meet_their_neighbours_once(spark, monkeypatch):
    square = lambda i, x, y: (i, f"s{i}", x, y, x + 0.25, y + 0.25)
    layer = rects(spark, [square(i, 77 + i % 4 * 0.25, 28 + i // 4 * 0.25) for i in range(16)] + [square(16, 77.0, 28.0)])
    met = []
    monkeypatch.setattr(tp, "grid_join", lambda left, *args, join=tp.grid_join, **kw: met.append(left.count()) or join(left, *args, **kw))
    snapped, fixes = tp.snap(layer)
    assert met[0] == 25 and fixes.count() == 0 and snapped.count() == 17


def test_boxes_that_only_touch_are_no_overlaps(spark):
    square = lambda i, x, y: (i, f"s{i}", x, y, x + 0.25, y + 0.25)
    layer = rects(spark, [square(i, 77 + i % 4 * 0.25, 28 + i // 4 * 0.25) for i in range(16)] + [square(16, 77.125, 28.0)])
    assert {(r.idx_a, r.idx_b) for r in sj.overlapping(layer).collect()} == {(0, 16), (1, 16)}

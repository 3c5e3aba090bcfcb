"""Feature collections read in byte ranges against a plain JSON parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plotweave.sources import readers as rd
from plotweave.sources.collections import read_elements


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3001", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def collection(rng, n, spaces):
    odd = ['a "quoted } { name"', "back\\slash\\", '\\"', "}{][", '"features":[{', "é中}", "", '"Feature"', "x" * 700]
    features = []
    for i in range(n):
        props = {"feature_id": f"F{i}", "note": rng.choice(odd), "more": rng.choice(odd)}
        x = rng.random()
        ring = [[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 0.0]]
        kind = {"type": "Feature", "properties": props, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        features.append(dict(rng.sample(list(kind.items()), 3)))
    root = {
        "type": "FeatureCollection", "name": rng.choice(odd), "other": [{"type": "Feature", "features": [{"a": 1}]}, [], {}],
        "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": features, "meta": {"features": [{"b": "}"}], "crs": {"x": {}}},
    }
    root = dict(rng.sample(list(root.items()), len(root)))
    return json.dumps(root, ensure_ascii=False, indent=1 if spaces else None) + rng.choice(["", "\n", " \n"]), features


def test_ranges_equal_a_whole_parse(spark, tmp_path, small_ranges):
    rng = random.Random(11)
    want, broken = {}, set()
    for i in range(5):
        text, features = collection(rng, rng.randint(20, 60), i % 2)
        name = f"{i}.geojson"
        if i == 3:  # ends in the middle
            text = text[: len(text) * 2 // 3]
            broken.add(name)
        elif i == 4:
            text = text.replace('"properties"', '"properties', 1)
            broken.add(name)
        else:
            want[name] = features
        (tmp_path / name).write_text(text, encoding="utf-8")
    elements, files = read_elements(spark, str(tmp_path))
    file = F.element_at(F.split("path", "/"), -1)
    got = {}
    for name, index, text in elements.where("kind = 'features'").select(file, "index", "text").collect():
        if name in want:
            got.setdefault(name, {})[index] = json.loads(text)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    whole = {r[0]: r[1] for r in files.select(file, "whole").collect()}
    assert {k for k, v in whole.items() if not v} == broken
    crs = {r[0]: json.loads(r[1])["properties"]["name"] for r in elements.where("kind = 'crs'").select(file, "text").collect() if r[0] in want}
    assert crs == dict.fromkeys(want, "EPSG:4326")
    rows = rd.read_geojson(spark, str(tmp_path)).select(file.alias("f"), "crs", "feature_index", F.col("properties")["note"].alias("note"), "geom.type").collect()
    assert {(r.f, r.crs, r.feature_index, r.note, r.type) for r in rows} == {
        (k, "EPSG:4326", i, f["properties"]["note"], "Polygon") for k, v in want.items() for i, f in enumerate(v)
    }
    issues = {(r[0], r.code) for r in rd.file_issues(spark, str(tmp_path)).select(file, "code").collect()}
    assert issues == {(n, "file_unreadable") for n in broken}


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    text, features = collection(random.Random(2), 300, False)
    (tmp_path / "one.geojson").write_text(text, encoding="utf-8")
    elements, _ = read_elements(spark, str(tmp_path))
    assert elements.where("kind = 'features'").count() == len(features)
    parts = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert parts.rdd.getNumPartitions() > 20


def test_files_without_features(spark, tmp_path):
    for name, text in (("a", ""), ("b", "{}"), ("c", '{"type":"FeatureCollection","features":[]}'), ("d", "no json"), ("e", '{"features":[{"type":"Feature"} x')):
        (tmp_path / f"{name}.geojson").write_text(text)
    issues = rd.file_issues(spark, str(tmp_path)).collect()
    assert {r.path[-9] for r in issues} >= {"b", "c", "d", "e"} and {r.code for r in issues} == {"file_unreadable"}
    assert rd.read_geojson(spark, str(tmp_path)).count() == 0

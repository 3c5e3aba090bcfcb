"""SimHash fingerprints and groups against brute force."""

import random

import pytest
import xxhash
from helpers import awkward, components, sentences
from pyspark.sql import functions as F

from plotweave.llm import simhash


def plain(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    fps = [plain(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    part = components(range(len(rows)), links)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[part[i]] = min(doc_id, low.get(part[i], doc_id))
    return sorted(((d, f"{f:016x}", low.get(part[i])) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr), part


def variants(rng):
    """Near copies that differ by a word, so that chains of links arise."""
    text = " ".join(sentences(rng, 30)).split()
    out = []
    for _ in range(60):
        text[rng.randrange(len(text))] = rng.choice(["one", "two", "three"])
        out.append(" ".join(text))
    return out


def test_groups(spark):
    df = awkward(spark, variants(random.Random(2)))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, part = brute(rows)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash(df).collect()), key=repr)
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(part.values()))
    assert simhash.keep_one(df.where("false")).count() == 0 == simhash.simhash(df.where("false")).count()


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash(df).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("blocks", [1, 2])
@pytest.mark.parametrize("small", [64, 3])
def test_both_ball_forms_find_the_same_classes(spark, monkeypatch, blocks, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(30)}
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << b) for b in range(64)} | {hub}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {r["fp"]: r["class"] for r in simhash.classes(df, blocks=blocks).collect()} == components(signed, links)


@pytest.mark.parametrize("radius", [2, 6])
def test_other_radii_lose_no_link(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in (0, radius, radius, radius + 1)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {r["fp"]: r["class"] for r in simhash.classes(df, radius).collect()} == components(signed, links)
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_variants_of_whole_words_are_not_broadcast(spark):
    df = spark.range(200).select("id", (F.col("id") * 3).alias("fp")).drop("id")
    plan = simhash.links(df, blocks=1)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 1  # emitted and shuffled once

"""Near copies by five-word shingles: recall against all pairs, clean documents, awkward rows."""

import random

import numpy as np
from helpers import awkward, components, sentences

from plotweave.llm import near


def similar(texts):
    """Pairs of texts that share 0.8 of their distinct shingles, from all pairs that share a shingle."""
    sets = [set(near.shingles((t or "").encode()).tolist()) for t in texts]
    by = {}
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(i)
    pairs = {(a, b) for group in by.values() if len(group) < 60 for a in group for b in group if a < b}
    return {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_recall_and_clean_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    pairs = similar([t for _, t in rows])
    part = components(range(len(rows)), pairs)
    copies = {i for i, low in part.items() if low != i}
    kept = {r.doc_id for r in near.keep_one(df).select("doc_id").collect()}
    gone = {i for i, (d, _) in enumerate(rows) if d not in kept}
    different = {i for i in copies if rows[i][1] not in {rows[j][1] for j in range(i) if part[j] == part[i]}}
    assert len(different) > 40 and len(different & gone) >= 0.9 * len(different)
    assert len(copies & gone) >= 0.95 * len(copies)
    # Nobody goes without a similar document.
    paired = {i for p in pairs for i in p}
    assert gone <= paired


def test_large_groups_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 5)
    rng = random.Random(3)
    base = " ".join(sentences(rng, 40)).split()
    texts = []
    for _ in range(120):
        mine = list(base)
        mine[rng.randrange(len(mine))] = "changed"
        texts.append(" ".join(mine))
    others = [" ".join(sentences(rng, 5)) for _ in range(30)]
    df = awkward(spark, texts + others + others[:4])
    kept = near.keep_one(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert sum(i is not None and 100 <= i < 220 for i in ids) == 1 and {220 + k for k in range(30)} <= set(ids)
    assert not {250, 251, 252, 253} & set(ids)
    assert 4 in ids and 5 not in ids and ids.count(7) == 1 and 1 in ids and not {2, 8} & set(ids)
    assert near.keep_one(df.where("false")).count() == 0


def test_fingerprint_words_are_apart():
    h = np.array([near.xxhash.xxh64_intdigest(str(i), 1) for i in range(501)], np.uint64)
    a, b = near.fingerprint(h)
    assert a != b and near.fingerprint(h[:0]) == (0, 0)
    assert a == sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h) > len(h))


def all_links(nodes):
    """{(u, v): d} of all pairs that meet, by the definition: words at most two bits apart in a table, and one octave there."""
    out = {}
    for a, (u, n) in enumerate(nodes):
        for v, k in nodes[:a]:
            x = (u[0] ^ v[0]) & (1 << 64) - 1 | ((u[1] ^ v[1]) & (1 << 64) - 1) << 64
            tables = [t for t in range(near.TABLES) if (x >> t * near.BITS & (1 << near.BITS) - 1).bit_count() <= 2]
            if x.bit_count() <= near.RADIUS and any(int(np.log2(n + 1.0) + t / near.TABLES) == int(np.log2(k + 1.0) + t / near.TABLES) for t in tables):
                out[min(u, v), max(u, v)] = x.bit_count()
    return out


def signed(x):
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def test_links_keep_groups_and_first_links(spark, monkeypatch):
    rng, nodes = random.Random(4), {}
    for size in (400, 60, 30, 9, 2, 1):
        base = rng.getrandbits(128)
        for _ in range(size):  # bits that change more often than others make chains and groups of several leaders
            x = base
            for k in rng.sample(range(128), rng.randint(0, 24)):
                x ^= 1 << k
            nodes[signed(x)] = rng.choice([40, 50, 60])
    nodes = sorted(nodes.items())
    want = all_links(nodes)
    ids = [w for w, _ in nodes]

    def first(links):
        out = {}
        for (u, v), d in links.items():
            for w in (u, v):
                out[w] = min(out.get(w, (99,)), (d, u, v))
        return out

    df = spark.createDataFrame([(*w, n) for w, n in nodes], "w0 long, w1 long, n int")
    for small in (4096, 16):
        monkeypatch.setattr(near, "SMALL", small)
        rows = near.near_links(df).collect()
        got = {((r.u0, r.u1), (r.v0, r.v1)): r.d for r in rows}
        assert len(got) == len(rows) and got.items() <= want.items()
        assert components(ids, got) == components(ids, want) and first(got) == first(want)


def test_all_members_of_a_group_are_compared(spark, monkeypatch):
    rng, texts = random.Random(6), []
    for length in (60, 80, 120):  # chains, in which most links do not share enough
        words = " ".join(sentences(rng, 12)).split()[:length]
        for _ in range(60):
            words[rng.randrange(len(words))] = rng.choice(["one", "two", "three"])
            texts.append(" ".join(words))
    rng.shuffle(texts)
    sets = [near.shingles(t.encode()) for t in texts]
    prints = [tuple(int(np.uint64(x).view(np.int64)) for x in near.fingerprint(s)) for s in sets]
    links = all_links([(p, len(s)) for p, s in zip(prints, sets)])
    group = components(set(prints), links)
    sets = [set(s.tolist()) for s in sets]
    same = [
        (i, j) for j in range(len(texts)) for i in range(j)
        if group[prints[i]] == group[prints[j]] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        and sum((a ^ b).bit_count() for a, b in zip(*[[x & (1 << 64) - 1 for x in prints[k]] for k in (i, j)])) <= near.RADIUS
    ]
    want = set(components(range(len(texts)), same).values())
    assert len(want) < len(texts) - 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for tile in (1 << 20, 1 << 14):
        monkeypatch.setattr(near, "TILE", tile, raising=False)
        assert {r.doc_id for r in near.keep_one(df).collect()} == want

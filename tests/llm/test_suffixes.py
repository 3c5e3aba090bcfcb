"""Suffix sorting and removal of repeated strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward

from plotweave.llm import suffixes
from plotweave.llm.induced import CAP, suffix_order

SF = "/root/testdata/sf0.001"


def brute_order(t):
    tails = [t[i:] for i in range(len(t))]
    order = sorted(range(len(t)), key=tails.__getitem__)
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(min(k, CAP))
    return order, lcp


@pytest.mark.parametrize("queue_bytes", [1 << 20, 40])
def test_order_and_prefixes(queue_bytes):
    rng = np.random.default_rng(1)
    for i in range(600):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50))
        t = np.repeat(np.tile(t, 1 + i % 4), 1 + i % 3).astype(np.int16)
        order, lcp = suffix_order(t, queue_bytes=queue_bytes)
        assert (order.tolist(), lcp.tolist()) == brute_order(t.tolist())


def test_long_repeats_pass_the_cap():
    t = np.tile(np.arange(1, 6), 200).astype(np.int16)
    order, lcp = suffix_order(t)
    assert (order.tolist(), lcp.tolist()) == brute_order(t.tolist())


def brute_removal(texts, span=suffixes.SPAN):
    count = Counter(b[i : i + span] for b in texts for i in range(len(b) - span + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def compare(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute_removal([(t or "").encode() for _, t in rows])
    got = suffixes.exact_dedup(df).collect()
    mine = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert mine == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def test_whole_table(spark):
    compare(spark.read.parquet(f"{SF}/documents.parquet"))


def test_awkward_rows(spark, monkeypatch):
    shared = "shared words in the middle of two texts, long enough to be found by any window of theirs; " * 3
    texts = [f"one {shared} end", f"two {shared} other", shared, "b" * 199, "b" * 199, "cd" * 150, "z" + "q" * 250]
    monkeypatch.setattr(suffixes, "HEAVY_PART", 1)  # every row is in the sample: the marked route is taken
    compare(awkward(spark, texts * 9))
    assert suffixes.exact_dedup(awkward(spark).where("false")).count() == 0

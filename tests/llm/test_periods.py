"""Periodic runs against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
from helpers import awkward

from plotweave.llm import periods


def brute(words):
    """All maximal runs, each period by itself; multiples of a period are told by their smaller one."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            s, stop = i, e + q
            if stop - s >= max(6, 4 * q) and not any(q % p == 0 and a <= s and stop <= b for a, p, b in found):
                found.append((s, q, stop))
            i = e + 1
    return sorted(found)


def planted(rng, letters):
    out = []
    for _ in range(rng.randint(1, 5)):
        out += rng.choices(letters, k=rng.randint(0, 12))
        out += (rng.choices(letters, k=rng.randint(1, 12)) * 9)[: rng.randint(1, 60)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(1)
    texts = [planted(rng, "abcdefgh"[: rng.randint(1, 8)]) for _ in range(700)]
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, list("abc" * 4), list("aab" * 40 + "aaaaaab" * 9)]
    texts += [list("abcdefghijklmnopqrstuvwxyz"[:k] * 4 + "xa") for k in range(1, 27)]
    texts += [[str(i % 97) for i in range(97 * 5 + 3)] + [str(i) for i in range(60)]]
    for part in (periods.PART_WORDS, 16, 41):
        ids, _, _, first, _ = periods.words_of(pa.array([" ".join(t) for t in texts]))
        got = periods.runs_of(ids, first, part)
        for words, runs in zip(texts, got, strict=True):
            assert [tuple(r) for r in runs.tolist()] == brute(words), (part, words)


def test_grammar_shrinks_and_rules_are_equal_words():
    rng = random.Random(2)
    words = np.array([rng.randint(0, 9) for _ in range(200)] * 6 + [3] * 300)
    owner = np.repeat([0, 1], [900, len(words) - 900])
    rule, at, mid, end, top = periods.re_pair(words, owner)
    assert len(top) < len(words) / 4 and len(at) == len(words) - len(top)
    assert (owner[at] == owner[end - 1]).all() and ((at < mid) & (mid < end)).all()
    seen = {}
    for r, a, m, e in zip(rule, at, mid, end, strict=True):
        assert seen.setdefault(int(r), (m - a, words[a:e].tolist())) == (m - a, words[a:e].tolist())
    assert all(sum(rule == r) > 1 for r in seen)


def test_long_copies_take_few_rounds():
    n = 40_000
    words = np.concatenate([np.arange(n)] * 2 + [np.zeros(n, int)] * 2)
    runs, _ = periods.grammar_runs(words, np.zeros(len(words), np.int64))
    assert [tuple(r) for r in periods._merged(runs)] == [(2 * n, 1, 4 * n)]


def collapsed(words, runs):
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows_of_a_table(spark):
    rng = random.Random(3)
    df = awkward(spark, [" ".join(planted(rng, ["x", "yé", "zz\t"])) for _ in range(40)])
    rows = periods.periodic_runs(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(rows) == df.count()
    for row in rows:
        if row.doc_id in (4, 5, None):
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id] or "")
        want = brute(words)
        assert row.n_words == len(words) and [(r.start, r.period, r.start + r.length) for r in row.runs] == want
        assert row.collapsed == collapsed(words, want)
    assert periods.periodic_runs(df.where("false")).count() == 0


def test_query_rows(spark):
    import hashlib
    import zlib

    from plotweave.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id] or "")
        h = zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want = brute(words)
        best = min(want, key=lambda r: (-(r[2] - r[0]) / r[1], r[0], r[1]), default=None)
        text = "".join(f"{s},{e - s},{q}\n" for s, q, e in want)
        assert (row.n_runs, row.runs_sha256) == (len(want), hashlib.sha256(text.encode()).hexdigest())
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
        top = best and (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1])
        assert (row.start, row.length, row.period, row.exponent_milli) == (top or (None,) * 4)

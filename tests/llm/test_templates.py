"""Decontamination: brute force over windows, re-parameterised questions, awkward rows."""

import random

from helpers import awkward, sentences

from plotweave.llm import templates


def brute(docs, items, width=templates.WINDOW, share=templates.SHARE):
    """Windows of all pairs of texts, slot by slot."""
    out = set()
    for doc_id, text in docs:
        dr, dk, dv = templates.canonical([text])
        for item_id, item in items:
            ir, ik, iv = templates.canonical([item])
            if not len(ik) or doc_id is None:
                continue
            w = min(width, len(ik))
            mine = {}
            for places, hashes in templates.window_hashes(dr, dk, dv, w):
                for p, h in zip(places.tolist(), hashes.tolist()):
                    mine.setdefault(h, []).append(p)
            offsets = {}
            for places, hashes in templates.window_hashes(ir, ik, iv, w):
                for p, h in zip(places.tolist(), hashes.tolist()):
                    for q in mine.get(h, []):
                        offsets.setdefault(q - p, set()).add((p, q))
            held = set()
            for pairs in offsets.values():
                slots = {(ik[p + k], iv[p + k], dv[q + k]) for p, q in pairs for k in range(w) if ik[p + k] != templates.LITERAL}
                if len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots}):
                    held |= {p for p, _ in pairs}
            if len(held) / max(1, len(ik) - w + 1) >= share:
                out.add((doc_id, item_id))
    return out


def test_whole_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in templates.leaks(docs, bench).collect()}
    assert got == brute(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect()) and got
    texts = {r.item_id: r.text for r in bench.collect()}
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if r.text and t in r.text}
    assert exact <= got


ITEM = "A train leaves the town of Ulm with 120 people and drives 45 km in 3 hours before Anna counts 120 tickets and calls Bert at home."


def test_other_numbers_and_names_are_found_and_mixed_up_ones_are_not(spark):
    rng = random.Random(1)
    around = " ".join(sentences(rng, 5))
    changed = ITEM.replace("120", "87").replace("45 km", "60 miles").replace("Anna", "Olga").replace("Ulm", "Graz")
    texts = [f"{around} {t} {around}" for t in (ITEM, changed, ITEM.upper(), changed.replace("87 tickets", "88 tickets"), " ".join(rng.sample(ITEM.split(), 26)))]
    df = awkward(spark, texts)
    bench = spark.createDataFrame([(1, ITEM, 2), (2, "", 2), (3, None, 2), (None, ITEM, 2), (4, "tiny item", 2)], "item_id long, text string, at int")
    got = {(r.doc_id, r.item_id) for r in templates.leaks(df, bench).collect()}
    assert got == {(100, 1), (101, 1), (102, 1)}
    left = templates.decontaminate(df, bench)
    assert left.columns == df.columns and left.count() == df.count() - 3
    assert templates.leaks(df, bench.where("false")).count() == 0 == templates.leaks(df.where("false"), bench).count()


def test_without_the_sieve(spark, monkeypatch):
    monkeypatch.setattr(templates, "SIEVE", 0)
    test_other_numbers_and_names_are_found_and_mixed_up_ones_are_not(spark)


def test_one_contradiction_costs_its_windows_only(spark):
    rng = random.Random(4)
    item = "The clerk wrote 31 letters in May. " + " ".join(sentences(rng, 1, 18)) + " The boxes took 31 sheets and " + " ".join(sentences(rng, 1, 18))
    moved = item.replace("31", "47")
    texts = [item.replace("The boxes", "This boxes"), item.replace("31 sheets", "32 sheets"), moved.replace("47 sheets", "48 sheets"),
             moved.replace("The boxes", "This boxes"), moved.replace("47 sheets", "48 sheets").replace("The boxes", "This boxes").replace("May", "The")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.share for r in templates.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), share=0.5).collect()}
    n = len(item.split()) - templates.WINDOW + 1
    # Four windows hold the first number, one the first name; both fewer than their rivals, but kept where word for word.
    assert {i: round(x * n) for i, x in got.items() if i < 4} == {0: n, 1: n, 2: n - 4, 3: n - 1}
    assert got.get(4, 0) < got[3]
    few = templates.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {0, 1, 2, 3} <= {r.doc_id for r in few.collect()}

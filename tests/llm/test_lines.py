"""Line dedup against brute force."""

import random
import tracemalloc

from helpers import SCHEMA, EXTRA, awkward, sentences

from plotweave.llm import lines

SF = "/root/testdata/sf0.001"


def brute(rows, min_words=lines.MIN_WORDS):
    """(doc key) -> set of deleted line numbers; every pair of windows is compared by its lines."""
    order = sorted({(i is None, i if i is not None else 0, t or "") for i, t in rows})
    seen, gone = {}, {}
    for key in order:
        all_lines = key[2].encode().split(b"\n")
        kept = [(i, x.strip()) for i, x in enumerate(all_lines) if x.strip()]
        for j in range(len(kept)):
            e, words = j, 0
            while e < len(kept) and words < min_words:
                words += len(kept[e][1].split())
                e += 1
            if words < min_words:
                break
            window = tuple(x for _, x in kept[j:e])
            if window in seen:
                gone.setdefault(key, set()).update(range(kept[j][0], kept[e - 1][0] + 1))
            seen.setdefault(window, key)
    return gone


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    # ties of id between different texts go by hash; the cases here have none that share lines
    want = {(k[1] if not k[0] else None, n) for k, lines_ in brute(rows).items() for n in lines_}
    got = {(r.doc_id, n) for r in lines.repeated_runs(df).collect() for n in range(r.first_line, r.first_line + r.n_lines)}
    assert got == want
    return got


def test_whole_table(spark):
    assert check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_runs_of_short_lines(spark):
    rng = random.Random(3)
    pool = sentences(rng, 30, words=3)
    texts = ["\n".join(rng.choices(pool, k=40) + sentences(rng, 3)) for _ in range(30)]
    texts.append("\n\n".join(texts[0].split("\n")[4:20]))
    assert check(awkward(spark, texts))


def test_deletion_keeps_first_place_and_other_columns(spark):
    a, b = "One long line of words that are here to be seen by the test twice.", "Another line with words that nobody repeats in the whole of it."
    rows = [(1, f"{a}\n{b}"), (2, f"x\n  {a} \ny"), (3, a), (4, None), (5, ""), (6, f"{b} no")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, *EXTRA) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in lines.line_dedup(df).collect()}
    assert {i: r.text for i, r in got.items()} == {1: f"{a}\n{b}", 2: "x\ny", 4: None, 5: "", 6: f"{b} no"}
    assert lines.line_dedup(df).columns == df.columns and got[2].k0 == "x" and got[2].runs == {"a": 1}
    assert lines.line_dedup(df.where("false")).count() == 0


def runs_brute(rows, min_words=lines.MIN_WORDS):
    """(id, line) of each line in a maximal common run of ``min_words`` words with an earlier place; all pairs of places."""
    docs = [(i, [(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.strip()]) for i, t in sorted(set(rows))]
    gone = set()
    for b, (name, mine) in enumerate(docs):
        for a in range(b + 1):
            theirs = docs[a][1]
            for i in range(len(mine)):
                for j in range(i if a == b else len(theirs)):
                    if i and j and mine[i - 1][1] == theirs[j - 1][1]:
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n][1] == theirs[j + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in mine[i : i + n]) >= min_words:
                        gone.update((name, x) for x, _ in mine[i : i + n])
    return gone


def test_runs_reach_their_ends(spark):
    rng = random.Random(8)
    pool = [sentences(rng, 1, words=rng.choice([1, 2, 4, 5, 7, 9, 12]))[0] for _ in range(14)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 14)) + sentences(rng, rng.randint(0, 2), words=3)) for _ in range(40)]
    head, tail = sentences(rng, 1)[0], "a tail of five words"
    texts += [head, f"{head}\n{tail}\nalone one", f"x\n{head}\n{tail}", f"{tail}\n{head}\n{tail}", f"y\n{tail}\n\n{head}\n{tail}"]
    rows = list(enumerate(texts))
    found = lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), ends_too=True).collect()
    filled = {(i, n) for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip()}
    got = {(r.doc_id, n) for r in found for n in range(r.first_line, r.first_line + r.n_lines)}
    assert got & filled == runs_brute(rows)
    assert {(42, 1), (42, 2), (44, 1), (44, 3), (44, 4)} <= got


def test_many_short_lines_hold_no_row_per_window():
    text = [b"w%d" % (i % 977) for i in range(60_000)]
    tracemalloc.start()
    n = sum(1 for _ in lines.fingerprints(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 59_991 and peak < 200 * n  # bytes

"""Quality rules: counts against brute force, the bound against exact sums, certified cutoffs on whole tables."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

from helpers import awkward
from pyspark.sql import functions as F

from plotweave.llm import rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        len(lines), len(re.findall("[!?]", text or "")), sum(c.isupper() for c in text or ""),
    )


def check(df):
    got = rules.measures(df.withColumn("whole", F.col("text")), ["doc_id", "whole"]).collect()
    assert len(got) == df.count()
    for row in got:
        assert tuple(row)[2:] == brute(row.whole), row.doc_id


def test_counts_of_awkward_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=rng.randint(0, 40))) for _ in range(60)]
    texts += ["\n".join(rng.choices(["x y", " x y", "", " ", "#z!"], k=9)) for _ in range(20)]
    texts += ["\x0b a\x0cb \r\n", "   x", "a b c d e a b c d e", "a a a a a a", "a a a a a"]
    df = awkward(spark, texts)
    check(df.where("length(text) < 20000 OR text IS NULL"))


def test_counts_of_a_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_bound_is_the_exact_binomial(spark):
    cases = [(k, n, p) for n in (1, 2, 19, 20, 21, 60, 400, 3000) for p in (0.02, 0.3) for k in range(0, int(n * p) + 1, max(1, int(n * p) // 4))]
    for p in (0.02, 0.3):
        mine = [(k, n) for k, n, q in cases if q == p]
        df = spark.createDataFrame(mine, "k long, n long").withColumn("got", rules.tail_probability(F.col("k"), F.col("n"), p))
        for k, n, got in df.collect():
            x = Fraction(str(p))
            a, b = x.numerator, x.denominator
            want = float(Fraction(sum(math.comb(n, j) * a**j * (b - a) ** (n - j) for j in range(k + 1)), b**n))
            assert math.isclose(got, want, rel_tol=1e-9), (k, n, p)
    assert spark.range(1).select(rules.tail_probability(F.lit(3), F.lit(10), 0.2)).first()[0] == 1.0


def test_candidates_leave_their_tails(spark):
    rng = random.Random(9)
    scores = [rng.randint(0, 300) for _ in range(2000)]
    cols = [f"s AS s_{r}" for r in rules.RULES]
    rows = [(s, 1) for s in scores] + [(299, 0)] * 18 + [(400, 0)] * 2
    df = spark.createDataFrame(rows, "s long, quality int").selectExpr("named_struct('lang', 'en') AS stratum", "quality", "s", *cols)
    got = rules.candidates(df).first().cutoffs
    assert set(rules.candidates(df.where("s < 400")).first().cutoffs) == {None}
    for c in got:
        for limit, tail in zip(c, rules.TAILS, strict=True):
            assert sum(s > limit for s in scores) <= tail * len(scores) < sum(s >= limit for s in scores)


def test_few_labels_reject_nothing(spark):
    df = awkward(spark, ["one two three four five six seven eight nine ten " + "#" * i for i in range(40)])
    labels = spark.createDataFrame([(100 + i, int(i < 20), "x") for i in range(40)] + [(None, 1, "x"), (100, None, "x")], "doc_id long, quality int, text string")
    rows = rules.quality_rules(df, labels).collect()
    assert len(rows) == df.count()
    assert all(r.kept == (not r.base_failed) and r.rejected_by == [] for r in rows)
    assert {r.base_failed for r in rows if r.doc_id in (1, 2, 3, 8)} == {True}
    assert rules.quality_rules(df.where("false"), labels).count() == 0
    assert rules.quality_rules(df, labels.where("false")).where("NOT kept AND NOT base_failed").count() == 0


def test_whole_table_keeps_good_documents_in_every_stratum(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = rules.quality_rules(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = got.where("NOT base_failed").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.groupby("lang").kept.mean() >= 1 - rules.ALPHA).all()
    # Of this table only long English texts have labels enough to certify a cutoff at all.
    assert (~bad[(bad.lang == "en") & (bad.n_words >= rules.LONG_WORDS)].kept).mean() > 0.95
    assert bad[(bad.lang != "en") | (bad.n_words < rules.LONG_WORDS)].kept.all()

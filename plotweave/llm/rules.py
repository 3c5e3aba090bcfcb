"""Quality rules with risk-controlled cutoffs; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import cut, held_out

#: White space between words, as a class of regular expressions.
SPACE = "[\\x20\\x09-\\x0D]"
#: Words in a window that counts as repeated.
WINDOW = 5
#: Part of the good documents of a stratum that cutoffs may reject, and the chance that any stratum exceeds it.
ALPHA, DELTA = 0.02, 0.05
#: Candidate cutoffs leave these parts of a stratum's good documents in the tuning half above them, rule by rule.
TAILS = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)
#: A rule takes part in a stratum if, over the most lenient cutoff, it finds this part of the bad tuning documents.
LEAST_GAIN = 0.05
#: Documents from so many words on form strata of their own.
LONG_WORDS = 100

#: Rule -> SQL of its score, a whole number that is higher for worse texts.
RULES = {
    "symbols": "1000 * n_symbols div nullif(word_chars, 0)",
    "marks": "1000 * n_marks div nullif(word_chars, 0)",
    "capitals": "1000 * n_capitals div nullif(word_chars, 0)",
    "repeated_words": "1000 * n_repeat_words div nullif(n_words, 0)",
    "repeated_lines": "1000 * n_dup_lines div nullif(n_lines, 0)",
    "long_words": "10 * word_chars div nullif(n_words, 0)",
    "short_words": "-(10 * word_chars div nullif(n_words, 0))",
}


def _matches(pattern: str) -> Column:
    return F.length(F.regexp_replace("text", f"[^{pattern}]+", "")).cast("long")


def _repeat_words(ordered: Column) -> Column:
    """Words in windows that occur twice or more; ``ordered`` has hash ``h`` and place ``i`` of each window, sorted.

    It is a column of its own: an expression would be evaluated again for each element.
    """
    # Of equal windows, all stand beside an equal one in this order.
    marked = F.transform(
        ordered,
        lambda x, k: F.when(
            ((k > 0) & (x["h"] == F.get(ordered, k - 1)["h"])) | x["h"].eqNullSafe(F.get(ordered, k + 1)["h"]), x["i"]
        ),
    )
    starts = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last"))

    def step(done, i):
        return F.struct((done["total"] + F.least(F.lit(WINDOW), i - done["last"])).alias("total"), i.alias("last"))

    return F.aggregate(starts, zero, step, lambda done: done["total"])


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_marks, n_capitals (long) of whole texts.

    Null is a text without words. n_lines counts lines with a word, n_dup_lines those equal
    to an earlier one. Windows are compared by 64-bit hashes within a text; a text without
    equal windows skips the sort that finds their places.
    """
    fixed = [F.col(c) for c in keep]
    bare = F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", "")
    text = docs.select(*fixed, F.coalesce("text", F.lit("")).alias("text")).withColumn("bare", bare)
    empty = F.array().cast("array<string>")
    split = text.select(
        *fixed,
        F.when(F.col("bare") == "", empty).otherwise(F.split("bare", f"{SPACE}+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")).alias("lines"),
        F.length(F.regexp_replace("text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        _matches("#*$%&|<>").alias("n_symbols"),
        _matches("!?").alias("n_marks"),
        _matches("\\p{Lu}").alias("n_capitals"),
    )
    words = F.col("words")
    window = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )
    hashed = split.select(
        *fixed, "word_chars", "n_symbols", "n_marks", "n_capitals",
        F.size(words).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= WINDOW, window).otherwise(F.array().cast("array<long>")).alias("hashes"),
    )
    hashes = F.col("hashes")
    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    more = ["n_lines", "n_marks", "n_capitals"]
    places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.select(*fixed, *counts, *more, F.when(twice, places).alias("ordered"))
    repeated = F.coalesce(_repeat_words(F.col("ordered")), F.lit(0).cast("long")).alias("n_repeat_words")
    return ordered.select(*fixed, *counts, repeated, *more)


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, exact up to 20, else Stirling's series (error below 1e-12)."""
    n = n.cast("double")
    tail = 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)
    series = n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + tail
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20.0)).cast("int")))).otherwise(series)


def tail_probability(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of the binomial of n draws with chance p, for k up to n * p; 1 beyond.

    The terms are summed downward from k, each from the one above it.
    """
    k, n = k.cast("long"), n.cast("long")
    odds = (1 - p) / p
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(done, j):
        term = done["term"] * (j + 1) / (n - j) * odds
        return F.struct(term.alias("term"), (done["sum"] + term).alias("sum"))

    below = F.when(k > 0, F.sequence(k - 1, F.lit(0).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(k <= n * p, F.exp(top) * F.aggregate(below, start, step, lambda done: done["sum"])).otherwise(1.0)


def _scored(rows: DataFrame) -> DataFrame:
    """``rows`` with the stratum and one score per rule under ``s_<rule>``."""
    long = F.when(F.col("n_words") >= LONG_WORDS, "long").otherwise("short")
    stratum = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.col("lang").isNull().alias("unknown"), long.alias("size"))
    return rows.select("*", stratum.alias("stratum"), *[F.expr(sql).alias(f"s_{r}") for r, sql in RULES.items()])


def _level(cutoffs: Column) -> Column:
    """Index of the first, most lenient, candidate that rejects the row; null if none does."""
    out = F.lit(None).cast("int")
    for t in reversed(range(len(TAILS))):
        over = [F.col(f"s_{r}") > F.get(F.get(cutoffs, F.lit(i)), F.lit(t)) for i, r in enumerate(RULES)]
        hit = over[0]
        for x in over[1:]:
            hit = hit | x
        out = F.when(F.coalesce(hit, F.lit(False)), t).otherwise(out)
    return out


def candidates(tuning: DataFrame) -> DataFrame:
    """(stratum, cutoffs): per rule one cutoff for each of TAILS, from ``tuning`` (stratum, quality, s_*).

    A cutoff is the smallest score of a good row that leaves at most that part of the
    stratum's good rows above it. Rules that find under LEAST_GAIN of the bad rows have
    null instead. Scores are counted by value before the shuffle.
    """
    stack = ", ".join(f"'{r}', s_{r}" for r in RULES)
    long = tuning.select("stratum", "quality", F.expr(f"stack({len(RULES)}, {stack}) AS (rule, s)")).where("s IS NOT NULL")
    counts = long.groupBy("stratum", "rule", "s").agg(F.count_if(F.col("quality") == 1).alias("n"), F.count_if(F.col("quality") == 0).alias("bad"))
    falling = F.sort_array(F.collect_list(F.struct("s", "n", "bad")), asc=False)
    values = counts.groupBy("stratum", "rule").agg(falling.alias("all"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    values = values.withColumn("v", F.filter("all", lambda x: x["n"] > 0)).where("n > 0")

    def least(tail: float) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("above"), F.get(F.col("v"), F.lit(0))["s"].alias("s"))

        def step(done, x):  # x.s may be the cutoff if the rows above it are few enough
            return F.struct((done["above"] + x["n"]).alias("above"), F.when(done["above"] <= F.col("n") * tail, x["s"]).otherwise(done["s"]).alias("s"))

        return F.aggregate("v", zero, step, lambda done: done["s"])

    top = F.get(F.col("v"), F.lit(0))["s"]
    found = F.aggregate(F.filter("all", lambda x: x["s"] > top), F.lit(0).cast("long"), lambda done, x: done + x["bad"])
    useful = found >= F.greatest(F.lit(1), F.col("bad") * LEAST_GAIN)
    per_rule = values.select("stratum", "rule", F.when(useful, F.array(*[least(t) for t in TAILS])).alias("c"))
    wide = per_rule.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("c"))).alias(r) for r in RULES])
    return wide.select("stratum", F.array(*RULES).alias("cutoffs"))


def thresholds(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs, chosen): certified cutoffs of each stratum, from labelled rows (stratum, quality, tune, s_*).

    Half of the rows tune, half certify. The candidates of the tuning half are tested on
    the good rows of the other from the most lenient on: one holds if, at a true rate of
    false rejections of ``alpha``, so few rejections would have a binomial probability of
    at most delta / (number of strata); testing stops at the first that fails. So with
    probability 1 - delta no stratum loses more than ``alpha`` of its good documents. Of
    the certified candidates ``chosen`` is the one that separates the tuning half best
    (bad rejected minus good rejected; ties: most lenient). Strata without one are absent.
    """
    limits = cut(candidates(labelled.where("tune")))
    strata = limits.count()
    met = labelled.join(limits, "stratum").select("stratum", "tune", "quality", _level(F.col("cutoffs")).alias("level"))
    counts = met.groupBy("stratum", "tune", "quality", "level").agg(F.count(F.lit(1)).alias("n"))
    wide = []
    for t in range(len(TAILS)):
        hit = F.col("level") <= t
        wide += [
            F.sum(F.when(~F.col("tune") & (F.col("quality") == 1) & hit, F.col("n")).otherwise(0)).alias(f"k{t}"),
            F.sum(F.when(F.col("tune") & (F.col("quality") == 0) & hit, F.col("n")).otherwise(0)).alias(f"bad{t}"),
            F.sum(F.when(F.col("tune") & (F.col("quality") == 1) & hit, F.col("n")).otherwise(0)).alias(f"good{t}"),
        ]
    totals = [
        F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name)
        for name, which in (
            ("n", ~F.col("tune") & (F.col("quality") == 1)),
            ("bad", F.col("tune") & (F.col("quality") == 0)),
            ("good", F.col("tune") & (F.col("quality") == 1)),
        )
    ]
    sums = counts.groupBy("stratum").agg(*wide, *totals)
    held = F.lit(True)
    options = []
    for t in range(len(TAILS)):
        held = held & (tail_probability(F.col(f"k{t}"), F.col("n"), alpha) <= delta / max(1, strata))
        gain = F.col(f"bad{t}") / F.greatest("bad", F.lit(1)) - F.col(f"good{t}") / F.greatest("good", F.lit(1))
        options.append(F.when(held, F.struct(gain.alias("gain"), F.lit(-t).alias("order"))))
    best = F.array_max(F.filter(F.array(*options), lambda x: x.isNotNull()))
    chosen = sums.select("stratum", (-best["order"]).alias("chosen")).where("chosen IS NOT NULL")
    return limits.join(chosen, "stratum")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept) per row of ``docs``.

    base_failed: under 10 words, or over a fifth of the words in repeated windows. Other
    rows are rejected by each rule whose score exceeds the certified cutoff of the row's
    stratum (language, null apart, and length); ``rejected_by`` names them. A stratum with
    too few labelled rows to certify a cutoff rejects nothing. Labels other than 0 and 1
    and null ids are left out; of several labels of one id the highest counts. Repeated
    rows get equal answers, extra columns are not read, an empty table gives no rows.
    """
    rows = cut(_scored(_based(measures(docs, ["doc_id", "lang"]))))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Rows that the base rules drop need no cutoff.
    labelled = rows.where("NOT base_failed").join(known, "doc_id").withColumn("tune", held_out(2, 0))
    limits = cut(thresholds(labelled.select("stratum", "quality", "tune", *[f"s_{r}" for r in RULES]), alpha, delta))
    joined = rows.join(limits, "stratum", "left")
    over = [
        F.when(F.col(f"s_{r}") > F.get(F.get("cutoffs", F.lit(i)), F.col("chosen")), F.lit(r)) for i, r in enumerate(RULES)
    ]
    rejected = F.array_compact(F.array(*over))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(*names, rejected.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def _based(rows: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)

"""Documents with awkward rows, and small brute-force helpers."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("k0", T.StringType()),
        T.StructField("fp", T.ArrayType(T.IntegerType())),
        T.StructField("score", T.StringType()),
        T.StructField("copy", T.IntegerType()),
        T.StructField("runs", T.MapType(T.StringType(), T.IntegerType())),
    ]
)
EXTRA = ("x", [1], "y", 7, {"a": 1})


def sentences(rng: random.Random, n: int, words: int = 12) -> list[str]:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [
        " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(words)).capitalize() + "." for _ in range(n)
    ]


def awkward(spark, texts=()):
    """Null and empty texts, null ids, repeated rows, ties, very long texts, then ``texts`` from id 100 on."""
    rng = random.Random(5)
    long = "\n".join(sentences(rng, 3000))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, "short", "en", "a"), (None, "no id but words", "de", "b"),
        (None, None, None, None), (4, long, "en", "a"), (5, long, "en", "b"), (6, "a" * 5000, "en", "c"),
        (7, "Twice the same row with a few words more than ten in one line here", "en", "a"),
        (7, "Twice the same row with a few words more than ten in one line here", "en", "a"),
        (8, " \n\t ", "fr", "c"), (9, "éè 中文 \U0001f600 " * 80, "fr", "c"), (10, "x\0y z" * 100, "fr", ""),
    ]
    rows += [(100 + i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *EXTRA) for r in rows], SCHEMA)


def components(nodes, links):
    """node -> smallest reachable node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}

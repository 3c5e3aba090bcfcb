"""Registered queries of the thirteen operators and the DuckDB oracles of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import alignment, language, lines, mixing, periods, quality, rules, secrets, simhash, suffixes, templates, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_suffix_array_dedup(spark, sf_dir):
    return suffixes.exact_dedup(_table(spark, sf_dir, "documents"))


@_query
def op2_line_dedup(spark, sf_dir):
    return lines.repeated_runs(_table(spark, sf_dir, "documents"), ends_too=True)


@_query
def op3_embedding_near_dedup(spark, sf_dir):
    return vectors.embedding_links(_table(spark, sf_dir, "embeddings"))


@_query
def op4_source_mixing(spark, sf_dir):
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op5_secret_scan(spark, sf_dir):
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


@_query
def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash(_table(spark, sf_dir, "documents"))


@_query
def op7_quality_classifier(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op8_url_filter(spark, sf_dir):
    return urls.url_filter(_table(spark, sf_dir, "pages"))


@_query
def op9_language_id(spark, sf_dir):
    return language.language_id(_table(spark, sf_dir, "documents"))


@_query
def op10_benchmark_decontamination(spark, sf_dir):
    return templates.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words to read of one document in ten: from some word on, the words of one period again and again."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


@_query
def op11_periodic_runs(spark, sf_dir):
    found = periods.periodic_runs(_table(spark, sf_dir, "documents"), _planted)
    first = F.get("runs", F.lit(0))
    # Runs are sorted, so of equal quotients the first stays.
    top = F.aggregate("runs", first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    ranked = found.withColumn("top", top)
    return ranked.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@_query
def op12_tokenizer_alignment(spark, sf_dir):
    return alignment.align(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


@_query
def op13_quality_rules(spark, sf_dir):
    got = rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    return got.select(*names)


@_query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op3_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9e0),
r AS (SELECT vec_id AS n, vec_id AS low FROM v UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.n),
c AS (SELECT n, min(low) AS component_id FROM r GROUP BY n),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.n = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""

ORACLES["op4_source_mixing"] = (
    mixing.MIX_SQL.format(docs="documents")
    + """SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM n"""
)

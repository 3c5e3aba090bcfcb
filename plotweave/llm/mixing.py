"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import cut, uniform

SEED = "mix"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0
) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Sources in code point order, null last, take the weights in turn. Together they get
    ``share`` times all sizes; a target stops at ``ceiling`` times its source, and what is
    above goes to the others by weight until none is above. That is the water level L
    with target = min(ceiling * source_size, L * weight): each pass computes the level
    from the sources found full so far, and full ones stay full, so it settles. Only
    three sums reach the driver per pass.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = cut(sums.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition: the running count over it needs no more than one task.
    before = counts.select(
        "part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.coalesce("before", F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = cut(
        dealt.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"))
    )
    top = F.col("source_size") * float(ceiling)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full_before = 0.0, -1
    while True:
        full = top <= F.lit(level) * F.col("weight")
        full_size, rest, n_full = table.agg(
            F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if n_full == full_before or rest == 0:
            break
        full_before, level = n_full, (share * total - full_size) / rest
    target = top if rest == 0 else F.least(top, F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate) copies and one more with probability equal to the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, n_copies), a row per row of ``docs``.

    The draw hashes id and text, so reruns agree whatever the partitions. Rows with equal
    id and text get equal draws. Null or empty texts have size 0 and are drawn like the
    rest; a source without words has target 0. Columns of ``docs`` other than doc_id,
    text and source are not read. An empty table gives no rows.
    """
    rows = cut(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            words(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"),
        ).withColumn("draw", uniform(SEED, "doc_id", "digest")).drop("digest")
    )
    targets = source_targets(rows, weights, share, ceiling).withColumnRenamed("source", "target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # The targets are a table of measured size: Spark broadcasts them below its threshold
    # and splits a hot source in a sorted join above it.
    return (
        rows.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("n_copies", copies(rate, F.col("draw")))
        .select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "source", "n_copies"
        )
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, and ``copy`` numbering the repeats from 0.

    Rows keep all their columns; if one is called ``copy``, the new one gets underscores
    until its name is free. See ``mix_plan`` for nulls, ties and empty tables.
    """
    number = "copy"
    while number in docs.columns:
        number += "_"
    sizes = cut(docs.select("source", words(F.col("text")).alias("size")))
    targets = source_targets(sizes, weights, share, ceiling).select(
        F.col("source").alias("mix_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("mix_rate"),
    )
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keep = [docs[c] for c in docs.columns]
    drawn = docs.select(*keep, digest.alias("mix_digest"))
    drawn = drawn.withColumn("mix_draw", uniform(SEED, "doc_id", "mix_digest"))
    joined = drawn.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    counted = joined.withColumn("mix_n", copies(F.col("mix_rate"), F.col("mix_draw"))).where("mix_n > 0")
    return counted.select(*docs.columns, F.explode(F.sequence(F.lit(0), (F.col("mix_n") - 1).cast("int"))).alias(number))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13))::BIGINT
      / 4503599627370496e0 AS draw
  FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    [3e0, 1e0, 2e0][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
r AS (SELECT *, sum(2e0 * source_size) OVER o AS full_size, sum(w) OVER o AS full_w, sum(w) OVER () AS all_w,
    1.5e0 * sum(source_size) OVER () AS pot, 2e0 * source_size / w AS ratio,
    lead(2e0 * source_size / w) OVER (ORDER BY 2e0 * source_size / w, source) AS next_ratio
  FROM s WINDOW o AS (ORDER BY 2e0 * source_size / w, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(
    (SELECT min((pot - full_size) / (all_w - full_w)) FROM r
     WHERE all_w > full_w AND ratio <= (pot - full_size) / (all_w - full_w) AND next_ratio > (pot - full_size) / (all_w - full_w)),
    (SELECT max(pot / all_w) FROM r)) AS level),
t AS (SELECT source, source_size, least(2e0 * source_size, level * w) AS target FROM s, l),
n AS (SELECT d.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""

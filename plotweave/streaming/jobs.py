"""Incremental ingest with validation, and running review state, on Structured Streaming.

The jobs append one folder per micro-batch to a store in shared storage. A batch that
is run again after a failure overwrites its own folder, so nothing is lost or doubled.
``compact`` folds finished batches into a generation; a reader takes the newest finished
generation and the batches behind it, so its cost does not grow with the batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotweave.operators.reconcile import canonical_decision
from plotweave.operators.validate import judged

FILES_PER_BATCH = 64


def stream_uploads(spark: SparkSession, folder: str, schema: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Uploaded GeoJSON-lines files as a stream; ``files_per_batch`` sets the pace, every file is read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def _append(store: str):
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return handle


def _run(rows: DataFrame, store: str, checkpoint: str, mode: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(_append(store))
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_ingest(uploads: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to ``store``, then stop.

    Rows carry dataset_id and upload_id; an upload may span any number of files and batches.
    """
    return _run(uploads, store, checkpoint, "append")


def run_validated_ingest(features: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """As ``run_ingest`` for features (dataset_id, upload_id, feature_index, geom, ...), stored with code and reason of their issue.

    Each feature is judged once, in the batch that brings it. ``upload_issues`` and
    ``upload_report`` read the store.
    """
    return _run(judged(features), store, checkpoint, "append")


def newest_uploads(rows: DataFrame) -> DataFrame:
    """Of each dataset all rows of its newest upload, which replaces older ones."""
    newest = rows.groupBy("dataset_id").agg(F.max("upload_id").alias("upload_id"))
    return rows.join(newest, ["dataset_id", "upload_id"], "left_semi")


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """The stored features that are current."""
    return newest_uploads(_stored(spark, store))


def upload_issues(spark: SparkSession, store: str) -> DataFrame:
    """Issue rows (dataset_id, feature_index, reason, code) of the current uploads."""
    return ingested(spark, store).where("code IS NOT NULL").select("dataset_id", "feature_index", "reason", "code")


def upload_report(spark: SparkSession, store: str, expected: DataFrame) -> DataFrame:
    """Per current upload: features, issues by code, whether all of ``expected`` (dataset_id, upload_id, expected) arrived, status.

    Status is ``uploaded`` until the upload is complete, then ``validated`` or ``invalid``.
    A feature that arrives twice under one feature_index counts once.
    """
    rows = ingested(spark, store).dropDuplicates(["dataset_id", "upload_id", "feature_index"])
    counts = rows.groupBy("dataset_id", "upload_id").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.count_if(F.col("code") == "empty_geometry").alias("empty_geometry"),
        F.count_if(F.col("code") == "invalid_geometry").alias("invalid_geometry"),
    )
    known = counts.join(expected, ["dataset_id", "upload_id"], "left")
    complete = F.coalesce(F.col("feature_count") == F.col("expected"), F.lit(False))
    status = F.when(~complete, "uploaded").when(F.col("empty_geometry") + F.col("invalid_geometry") == 0, "validated").otherwise("invalid")
    return known.withColumn("complete", complete).withColumn("status", status).drop("expected")


def _folders(spark: SparkSession, store: str) -> tuple[int, list[int]]:
    """(newest finished generation or -1, finished batches behind it): names of folders, no data."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(sc._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "generation": []}
    for entry in fs.listStatus(path(store)):
        kind, _, number = entry.getPath().getName().partition("=")
        if kind in found and fs.exists(path(f"{store}/{kind}={number}/_SUCCESS")):
            found[kind].append(int(number))
    last = max(found["generation"], default=-1)
    return last, sorted(b for b in found["batch"] if b > last)


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the newest generation and of the batches behind it."""
    last, batches = _folders(spark, store)
    tail = [f"{store}/batch={b}" for b in batches]
    parts = [spark.read.parquet(*paths) for paths in ([f"{store}/generation={last}"] * (last >= 0), tail) if paths]
    return reduce(DataFrame.unionByName, parts)


def compact(spark: SparkSession, store: str, fold: Callable[[DataFrame], DataFrame]) -> int:
    """Write the rows that ``fold`` leaves of the store as a new generation; gives the last batch in it, -1 if there is none.

    ``fold`` must not mind being applied again to its result and later rows, as
    ``newest_uploads`` and ``review_state`` do not. A generation counts once it is wholly
    written, so a stream may go on meanwhile, and a failed run changes nothing. Folders
    it replaces are left to the storage's own clean-up.
    """
    last, batches = _folders(spark, store)
    if not batches:
        return last
    fold(_stored(spark, store)).write.mode("overwrite").parquet(f"{store}/generation={batches[-1]}")
    return batches[-1]


def review_state(reviews: DataFrame) -> DataFrame:
    """Latest canonical decision per conflict; by event time, so late rows lose on their own.

    Works on a stream (update mode) and on a table alike.
    """
    last = F.max_by(
        F.struct("event_id", "ts", canonical_decision("decision").alias("decision")), F.struct("ts", "event_id")
    )
    return reviews.groupBy("conflict_id").agg(last.alias("_r")).select("conflict_id", "_r.event_id", "_r.ts", "_r.decision")


def run_reviews(reviews: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Maintain the review state: each batch writes the conflicts whose state it changed, from the executors."""
    return _run(review_state(reviews), store, checkpoint, "update")


def stored_reviews(spark: SparkSession, store: str) -> DataFrame:
    """Latest state per conflict in ``store``."""
    return review_state(_stored(spark, store)).drop("ts")

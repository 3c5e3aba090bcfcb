"""Helpers the operators share: row keys, scratch tables, Arrow text access and sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.session import discard, stored as cut

#: Bytes of text that one vectorized step takes at most, unless a single row is longer.
STEP_BYTES = 2 << 20
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 4 << 20

__all__ = ["cut", "discard", "held_out", "map_texts", "raw", "row_key", "steps", "uniform"]


def row_key() -> list[Column]:
    """Three columns that tell documents apart: the id and 128 bits of the text.

    Rows with equal id and text share a key; operators treat them alike. Null ids and
    texts have keys of their own.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("k0"),
        F.xxhash64(F.lit(1), F.col("text").isNull(), F.col("text")).alias("k1"),
        F.xxhash64(F.lit(2), F.col("text")).alias("k2"),
    ]


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def uniform(seed: str, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone (52 bits of an MD5)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null is empty. Shares the array's memory where it can."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (a longer row stands alone)."""
    for batch in batches:
        offsets, _ = raw(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def bound_batches(df: DataFrame) -> None:
    """Lower the session's limit of bytes in an Arrow batch to BATCH_BYTES, unless it is lower already.

    The default of 64 MB is held several times over, by each task and its Python worker.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name, None) or ""
    if not held.removesuffix("b").isdigit() or int(held.removesuffix("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")


def map_texts(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, limit: int = STEP_BYTES
) -> DataFrame:
    """mapInArrow in steps of about ``limit`` bytes of text; ``fn`` takes a batch with a ``text`` column and gives rows of ``schema``.

    Batches between Spark and Python are held to BATCH_BYTES, whatever the length of texts.
    """
    bound_batches(df)

    def run(batches):
        for batch in steps(batches, limit):
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out
        pa.default_memory_pool().release_unused()  # workers are used again

    return df.mapInArrow(run, schema)

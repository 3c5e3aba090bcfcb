"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm.common import bound_batches, cut, row_key, steps

#: A repeated run counts from so many words on.
MIN_WORDS = 10
#: Windows that a task hands on at once.
ROWS = 4096

_KEY = ["k0", "k1", "k2"]


def fingerprints(lines: list[bytes], min_words: int = MIN_WORDS, ends_too: bool = True) -> Iterator[tuple[int, int, int, int]]:
    """(fingerprint, first line, number of lines, hash of these lines) of each window of a text.

    A window is the shortest run of lines from its first on, or up to its last, with
    ``min_words`` words; it neither starts nor ends with a blank line. Its fingerprint is
    the smallest hash of a line in it. Equal windows have equal fingerprints. A shared run
    of ``min_words`` words is the union of the windows in it: a line with fewer words up to
    it lies in the window from the run's first line on, any other ends a window of the run.
    Without ``ends_too`` windows start at each line only.
    """
    kept = [line.strip() for line in lines]
    at = [i for i, line in enumerate(kept) if line]
    kept = [line for line in kept if line]
    n = len(kept)
    counts = np.fromiter((len(line.split()) for line in kept), np.int64, n)
    hashes = [xxhash.xxh3_64_intdigest(line) for line in kept]
    reach = np.cumsum(counts)
    ends = np.searchsorted(reach, reach - counts + min_words)
    found = np.flatnonzero(ends < n) * n + ends[ends < n]
    if ends_too:
        starts = np.searchsorted(reach - counts, reach - min_words, "right") - 1
        found = np.sort(np.append(found, starts[starts >= 0] * n + np.flatnonzero(starts >= 0)))
        found = found[np.diff(found, prepend=-1) > 0]
    for w in found:  # as they are wanted, so that a text of many short lines holds no row per window
        j, e = divmod(int(w), n)
        whole = xxhash.xxh3_128_intdigest(b"\n".join(kept[j : e + 1]))
        yield min(hashes[j : e + 1]), at[j], at[e] - at[j] + 1, whole


def windows(docs: DataFrame, min_words: int = MIN_WORDS, ends_too: bool = True) -> DataFrame:
    """(k0, k1, k2, fp, at, n, w1, w2): the windows of ``docs`` (k0, k1, k2, text)."""
    names, kinds = [*_KEY, "fp", "at", "n", "w1", "w2"], [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 2

    def rows(batch):
        for i in range(batch.num_rows):
            k0, k1, k2, text = (batch.column(c)[i].as_py() for c in (*_KEY, "text"))
            for fp, at, n, w in fingerprints((text or "").encode().split(b"\n"), min_words, ends_too):
                yield k0, k1, k2, fp - (1 << 63), at, n, (w >> 64) - (1 << 63), (w & (1 << 64) - 1) - (1 << 63)

    def run(batches):
        for batch in steps(batches):
            found = rows(batch)
            while some := list(islice(found, ROWS)):
                cols = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        pa.default_memory_pool().release_unused()  # workers are used again

    bound_batches(docs)
    return docs.mapInArrow(run, "k0 long, k1 long, k2 long, fp long, at int, n int, w1 long, w2 long")


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS, ends_too: bool = True) -> DataFrame:
    """(k0, k1, k2, runs): lines (at, n) of documents (k0, k1, k2, text) that repeat an earlier place.

    Fingerprints join positions: those of one place only are dropped. Where several places
    share one, a window that was seen at an earlier place (by id, null last, then text hash,
    then line) is marked. Windows reach from each line both ways, so marks add up to whole
    repeated runs, whichever earlier place has the longest. Minima are aggregated before
    the shuffle; a line that very many documents share is a skewed join, which Spark splits.
    """
    rows = cut(windows(docs, min_words, ends_too))
    place = F.struct((F.col("k0") == -(1 << 62)).alias("no_id"), "k0", "k1", "k2", "at")
    shared = rows.groupBy("fp").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("fp")
    # As tables, both are plain sides of a join, whose skewed partitions Spark can split.
    met = cut(rows.join(cut(shared), "fp", "left_semi"))
    firsts = met.groupBy("w1", "w2").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    firsts = cut(firsts.where("low < high").select("w1", "w2", "low"))
    later = met.join(firsts, ["w1", "w2"]).where(place > F.col("low")).select(*_KEY, "at", "n")
    return later.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "n")).alias("runs"))


def _merge(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["at"], r["at"] + r["n"]) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, ends_too: bool = False) -> DataFrame:
    """(doc_id, first_line, n_lines): the runs of lines that repeat an earlier place.

    Rows of equal id and text are one document. Null ids come last in the order of places.
    ``ends_too`` gives the runs to their ends, as ``line_dedup`` deletes them; without it
    they end with the last window that starts in them.
    """
    plain = docs.select("doc_id", "text", *row_key())
    found = cut(later_runs(plain.select(*_KEY, "text"), min_words, ends_too))

    def run(batches):
        for batch in batches:
            rows = [
                (*key, s, e - s)
                for *key, runs in zip(*[batch.column(k).to_pylist() for k in (*_KEY, "runs")], strict=True)
                for s, e in _merge(runs)
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*_KEY, "first_line", "n_lines"])

    merged = found.mapInArrow(run, "k0 long, k1 long, k2 long, first_line long, n_lines long")
    null_id = F.when(F.col("k0") != -(1 << 62), F.col("k0"))
    return merged.select(null_id.alias("doc_id"), "first_line", "n_lines")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from their texts.

    A run counts if it holds ``min_words`` words at least; lines are compared without
    surrounding white space and end at a newline. The first place of a run, by id (null
    last), text and line, keeps it. A document that loses words and has none left is
    dropped; one that had none stays. Texts without repeats stay as they are, also null and
    empty ones. Rows of equal id and text are one document and are treated alike. All
    columns are kept, ``n_chars`` follows a changed text; an empty table gives no rows.
    """
    names = [f"line_dedup_{k}" for k in _KEY]
    keyed = docs.select(*docs.columns, *[c.alias(n) for c, n in zip(row_key(), names, strict=True)])
    found = cut(later_runs(docs.select(*row_key(), "text"), min_words))
    runs = found.select(*[F.col(k).alias(n) for k, n in zip(_KEY, names, strict=True)], F.col("runs").alias("line_dedup_runs"))

    @F.pandas_udf("string")
    def rest(texts, runs):
        out = []
        for text, gone in zip(texts, runs, strict=True):
            if gone is None or text is None:
                out.append(text)
                continue
            lines, kept, at = text.split("\n"), [], 0
            for s, e in _merge(list(gone)):
                kept += lines[at:s]
                at = e
            kept += lines[at:]
            out.append("\n".join(kept) if any(x.strip() for x in kept) else None)
        return type(texts)(out, dtype=object)

    bound_batches(docs)
    joined = keyed.join(runs, names, "left")
    hit = joined.where("line_dedup_runs IS NOT NULL").withColumn("text", rest("text", "line_dedup_runs"))
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.NumericType):
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    clean = joined.where("line_dedup_runs IS NULL")
    return clean.select(*docs.columns).unionByName(hit.where("text IS NOT NULL").select(*docs.columns))

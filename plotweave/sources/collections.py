"""Feature collections read in byte ranges: one large file is the work of many tasks.

Spark's text source cuts files into ranges and gives them in pieces that end with ``}``.
Whether a range begins inside a string and at which depth is not known from the range
alone, so a first scan sums up each range under both answers to the first question; the
ranges of a file are then chained, and a second scan picks the features. A feature that
crosses ranges leaves a part in each, which are joined.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.session import cut

#: Bytes of a range that are looked at together.
STEP = 4 << 20

_KEY_BEFORE = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_FEATURES, _CRS = "features", "crs"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", False).text(path)
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")]
    return rows.select(*meta, F.col("value").cast("binary").alias("value"))


def _steps(batches):
    """(path, start, size of the file, bytes, last step of the range) in the order of each range."""
    held, size, key = [], 0, None
    for batch in batches:
        names = ("file_path", "file_block_start", "file_size", "value")
        for path, start, total, value in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if key is not None and (key != (path, start, total) or size > STEP):
                yield *key, b"".join(held), key != (path, start, total)
                held, size = [], 0
            key = (path, start, total)
            held += [value, b"}"]
            size += len(value) + 1
    if key is not None:
        yield *key, b"".join(held), True


def _borders(data: np.ndarray) -> np.ndarray:
    """Quotation marks behind an even number of backslashes, which begin and end strings."""
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != 92, place, -1))
    before = np.append(-1, plain[:-1])  # the last byte before each place that is no backslash
    return (data == 34) & ((place - 1 - before) % 2 == 0)


def _brackets(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, steps): brackets outside strings and +1 or -1 for each."""
    at = np.flatnonzero(((data == 123) | (data == 91) | (data == 125) | (data == 93)) & ~inside)
    return at, np.where((data[at] == 123) | (data[at] == 91), 1, -1)


def _opened(text: bytes, at: int) -> str:
    """A container's bracket and the key before it."""
    key = _KEY_BEFORE.search(text[max(0, at - 256) : at])
    return chr(text[at]) + (key[1].decode("utf-8", "replace") if key else "")


def _chained(stack: list[str], low: int, opened: list[str]) -> list[str]:
    """Open containers after a stretch that closes ``-low`` of them and opens others."""
    return [*stack[: max(0, len(stack) + low)], *opened]


def _summaries(batches):
    """Per range and answer: bytes, whether it ends inside a string, lowest depth, depth at its end, containers left open."""
    state = None
    for path, start, total, text, last in _steps(batches):
        if state is None:
            state = {"n": 0, "odd": False, "sides": [(0, 0, []), (0, 0, [])]}
        data = np.frombuffer(text, np.uint8)
        borders = _borders(data)
        odd = (np.cumsum(borders) - borders) % 2 == 1
        for h in (0, 1):
            at, step = _brackets(data, odd ^ state["odd"] ^ bool(h))
            low, depth, stack = state["sides"][h]
            if len(at):
                level = np.cumsum(step)
                lasting = np.minimum.accumulate(level[::-1])[::-1]
                below = min(0, int(level.min()))
                stay = at[(step > 0) & (lasting >= level) & (level > below)]
                low = min(low, depth + below)
                stack = _chained(stack, below, [_opened(text, int(i)) for i in stay])
                depth += int(level[-1])
            state["sides"][h] = (low, depth, stack)
        state["odd"] ^= bool(borders.sum() % 2)
        state["n"] += len(text)
        if last:
            for h in (0, 1):
                low, depth, stack = state["sides"][h]
                yield path, start, total, h, state["n"], state["odd"] ^ bool(h), low, depth, stack
            state = None


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, size, inside, bytes, ends_inside, low, depth, open): each range under both answers."""

    def run(batches):
        rows = list(_summaries(batches))
        cols = list(zip(*rows, strict=True)) or [[]] * 9
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        names = ["path", "start", "size", "inside", "bytes", "ends_inside", "low", "depth", "open"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kinds = "path string, start long, size long, inside int, bytes long, ends_inside boolean, low long, depth long, open array<string>"
    return _pieces(spark, path).mapInArrow(run, kinds)


def _element(stack: list[str]) -> str | None:
    """The kind of element that these open containers lie in: a feature or the reference system."""
    if len(stack) > 1 and stack[1] == "{" + _CRS:
        return _CRS
    if len(stack) > 2 and stack[1] == "[" + _FEATURES and stack[2][0] == "{":
        return _FEATURES
    return None


def chain(parts: list) -> tuple[dict[int, tuple], bool]:
    """(start of a range -> (inside a string, open containers, range where the open element began), whether the file is whole).

    ``parts``: rows of ``ranges`` of one file. The text source ends each piece, also a last
    one without ``}``, as if it had one; the bytes tell, and such a file ends one lower.
    """
    by = {(p["start"], p["inside"]): p for p in parts}
    inside, stack, depth, origin, size, states = 0, [], 0, None, 0, {}
    for start in sorted({p["start"] for p in parts}):
        states[start] = (bool(inside), stack, origin)
        p = by[start, inside]
        kept = len(stack) + p["low"]
        after = _chained(stack, p["low"], p["open"])
        element = _element(after)
        floor = 2 if element == _CRS else 3
        if element is None:
            origin = None
        elif kept < floor:  # it was opened in this range
            origin = start
        stack, depth, inside, size = after, depth + p["depth"], int(p["ends_inside"]), size + p["bytes"]
    extra = size - parts[0]["size"]
    return states, not inside and depth == -extra and extra in (0, 1)


def _elements(text: bytes, inside: bool, stack: list[str]):
    """(elements, inside, stack) of a step: each element is (kind, begins here, bytes, ends here)."""
    data = np.frombuffer(text, np.uint8)
    borders = _borders(data)
    at, step = _brackets(data, ((np.cumsum(borders) - borders) % 2 == 1) ^ inside)
    level = len(stack) + np.cumsum(step)
    below = min(len(stack), int(level.min(initial=len(stack))))
    lasting = np.minimum.accumulate(level[::-1])[::-1]
    stay = at[(step > 0) & (lasting >= level) & (level > below)]
    after = [*stack[: max(0, below)], *[_opened(text, int(i)) for i in stay]]
    out, begin, kind = [], 0, _element(stack)
    high = level + (step < 0) <= 3
    # Only brackets between the first three levels matter here; deeper ones come in between unseen.
    for i, s, lv in zip(at[high].tolist(), step[high].tolist(), level[high].tolist(), strict=True):
        if s > 0:
            stack = [*stack[: lv - 1], _opened(text, i)]
            if kind is None and _element(stack) is not None:
                kind, begin = _element(stack), i
                out.append([kind, True, None, False])
        else:
            stack = stack[: max(0, lv)]
            if kind is not None and _element(stack) is None:
                if out and out[-1][2] is None:
                    out[-1][2:] = [text[begin : i + 1], True]
                else:
                    out.append([kind, False, text[: i + 1], True])
                kind = None
    if kind is not None:
        if out and out[-1][2] is None:
            out[-1][2] = text[begin:]
        else:
            out.append([kind, False, text, False])
    return out, bool(inside ^ bool(borders.sum() % 2)), after


def _cut_elements(batches, states: dict[tuple[str, int], tuple]):
    """Lists of (path, kind, range, seq, part, bytes) of the elements of some ranges; see ``elements``."""
    held, state, seq, origin, out, size = [], None, 0, None, [], 0
    for path, start, _, text, last in _steps(batches):
        if state is None:
            inside, stack, origin = states.get((path, start), (False, [], None))
            state, seq, held = (inside, stack), 0, []
        found, *state = _elements(text, *state)
        for kind, begins, part, ends in found:
            if begins:
                origin, held = start, []
            held.append(part)
            if ends:
                here = origin == start
                out.append((path, kind, origin, seq if here else -1, start, b"".join(held)))
                seq += here and kind == _FEATURES
                held = []
        if last:
            if held:
                out.append((path, kind, origin, -1, start, b"".join(held)))
            state, held = None, []
        size += len(text)
        if size > STEP or last:
            yield out
            out, size = [], 0
    yield out


def elements(spark: SparkSession, path: str, states: dict[tuple[str, int], tuple]) -> DataFrame:
    """(path, kind, range, seq, part, text): elements of the files, cut where they cross ranges.

    ``states`` has what ``chain`` gives for ranges that do not begin a file. All parts of an
    element carry the range it begins in; the parts of one that does not end there have
    seq -1, and ``part`` is their own range.
    """
    sent = spark.sparkContext.broadcast(states)

    def run(batches):
        for out in _cut_elements(batches, sent.value):
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "kind", "range", "seq", "part", "text"])

    return _pieces(spark, path).mapInArrow(run, "path string, kind string, range long, seq long, part long, text binary")


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements, files): (path, kind, index, text) of whole features and reference systems, and (path, whole) of all files.

    What reaches the driver is one row per range of the files that have several.
    """
    known = cut(ranges(spark, path))
    several = known.where("start > 0").select("path").distinct()
    states, wholes = {}, []
    by: dict[str, list] = {}
    for row in known.join(several, "path", "left_semi").toLocalIterator():
        by.setdefault(row["path"], []).append(row)
    for name, parts in by.items():
        found, whole = chain(parts)
        states |= {(name, start): state for start, state in found.items()}
        wholes.append((name, whole))
    extra = F.col("bytes") - F.col("size")
    single = known.where("inside = 0").join(several, "path", "left_anti")
    files = single.select("path", (~F.col("ends_inside") & (F.col("depth") == -extra) & extra.isin(0, 1)).alias("whole"))
    if wholes:
        files = files.unionByName(spark.createDataFrame(wholes, "path string, whole boolean"))
    rows = cut(elements(spark, path, states))
    parts = rows.where("seq < 0").groupBy("path", "kind", "range").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    joined = parts.select("path", "kind", "range", F.expr("array_join(transform(p, x -> cast(x.text AS string)), '')").alias("text"))
    # An element that crosses ranges is the last that begins in its first one.
    counts = rows.where("seq >= 0").groupBy("path", "kind", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.join(joined.select("path", "kind", "range", F.lit(1).alias("m")), ["path", "kind", "range"], "full")
    sizes = cut(starts.select("path", "kind", "range", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")))
    earlier = F.sum(F.col("n") + F.col("m")).over(Window.partitionBy("path", "kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(sizes.select("path", "kind", "range", "n", F.coalesce(earlier, F.lit(0)).alias("before")))
    plain = rows.where("seq >= 0").select("path", "kind", "range", "seq", F.col("text").cast("string").alias("text"))
    last = joined.join(offsets.select("path", "kind", "range", F.col("n").alias("seq")), ["path", "kind", "range"])
    both = plain.unionByName(last.select(*plain.columns)).join(offsets.drop("n"), ["path", "kind", "range"])
    return both.select("path", "kind", (F.col("before") + F.col("seq")).cast("int").alias("index"), "text"), files

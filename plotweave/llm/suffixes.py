"""Removal of repeated byte strings by suffix sorting over the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import cut, map_texts, raw
from plotweave.llm.induced import suffix_order

#: Strings of SPAN bytes meet at the smallest hash of their substrings of GRAM bytes.
SPAN, GRAM = 200, 64
#: Bytes of segments that are sorted together, unless one anchor has more.
SHARD_BYTES = 1 << 20
#: Bytes of text hashed at once; a dozen arrays of eight bytes for each are alive.
STEP = 1 << 20
#: Segments whose rows are marked without meeting, found in one of so many documents. Routing only.
HEAVY, HEAVY_PART = 512, 64

_rng = np.random.default_rng(17)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASES = _rng.integers(1 << 62, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Of SPAN bytes that hold an anchor, at least SIDE lie on one side of it.
SIDE = (SPAN - GRAM) // 2

_SEGMENT = "anchor long, h1 long, h2 long, left int, right int, k0 long, k1 int, at int, size int"


def key_columns() -> list[F.Column]:
    """(k0, k1): 96 bits that tell documents apart; rows of equal id and text share them.

    A null id is replaced by a hash of the text.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("k0"),
        F.hash(F.col("doc_id").isNull(), F.col("text")).alias("k1"),
    ]


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash, left, right) of the segments of some texts.

    Every start of SPAN bytes within a text belongs to one segment: neighbouring starts
    whose smallest substring hash, leftmost on ties, is at the same place. Which place
    that is depends on the SPAN bytes alone, so equal strings have equal anchors at equal
    distance. ``left`` and ``right`` hash the anchor with SIDE bytes before or after it, as
    far as the segment has them: segments that share a string agree in one of the two.
    """
    empty = (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.int32) for _ in range(2)))
    n = len(data)
    if n < SPAN:
        return empty
    h = _TABLE[data]
    for k in range(6):
        half = 1 << k
        h = h[:-half] * _BASES[k] + h[half:]
    h ^= h >> np.uint64(29)
    h *= _MIX
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, low, have = SPAN - GRAM + 1, key, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    lengths = np.diff(offsets)
    long = lengths >= SPAN
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[:-1][long] + lengths[long] - SPAN + 1, -1)
    ok = np.cumsum(inside[: len(place)]) > 0
    starts = np.flatnonzero(ok)
    if not len(starts):
        return empty
    m = place[starts]
    fresh = np.append(True, (m[1:] != m[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = starts[fresh]
    last = starts[np.append(np.flatnonzero(fresh)[1:], len(starts)) - 1]
    # Neighbouring texts never share a segment: starts of one end before the next begins,
    # as SPAN is over 1.
    rows = np.searchsorted(offsets, first, "right") - 1
    m = m[fresh]

    def side(a, b, ok):
        """32 bits of what GRAM bytes at a, at b and at the anchor say; 0 if not ``ok``."""
        a, b = (np.clip(x, 0, len(h) - 1) for x in (a, b))
        mixed = ((h[a] * _BASES[0]) ^ (h[b] * _BASES[1]) ^ h[m]) * _MIX
        return np.where(ok, (mixed >> np.uint64(33)).astype(np.int64) + 1, 0).astype(np.int32)

    left = side(m - SIDE, m - SIDE + GRAM, m - SIDE >= first)
    right = side(m + SIDE, m + GRAM, m + SIDE + GRAM <= last + SPAN)
    return rows, first, last, h[m].view(np.int64), left, right


def segments(docs: DataFrame, heavy: dict | None = None) -> DataFrame:
    """(route, known, anchor, h1, h2, left, right, k0, k1, at, size): the segments of ``docs`` (k0, k1, text).

    ``at`` is the first byte in the text and ``size`` the bytes from the first start to the
    end of the last string; h1 and h2 are 128 bits of these bytes. ``route`` is the anchor.
    A segment listed in ``heavy`` is known to repeat: its rows, except the one listed,
    are routed by document, as they need not meet.
    """
    heavy = heavy or {}
    listed = np.array(sorted(h for h, _ in heavy), np.int64)

    def run(batch):
        offsets, data = raw(batch.column("text"))
        rows, first, last, anchor, left, right = anchors(offsets, data)
        buffer, ends = memoryview(np.ascontiguousarray(data)), last + SPAN
        digests = b"".join(xxhash.xxh3_128_digest(buffer[s:e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True))
        h = np.frombuffer(digests, "<i8").reshape(-1, 2)
        k0 = batch.column("k0").to_numpy(zero_copy_only=False)[rows]
        k1 = batch.column("k1").to_numpy(zero_copy_only=False)[rows]
        at = first - offsets[rows]
        known, route = np.zeros(len(rows), bool), anchor.copy()
        for i in np.flatnonzero(np.isin(h[:, 0], listed)).tolist():
            row = heavy.get((int(h[i, 0]), int(h[i, 1])))
            if row is not None:
                known[i] = True
                if row != (int(k0[i]), int(k1[i]), int(at[i])):
                    route[i] = xxhash.xxh64_intdigest(h[i].tobytes(), int(k0[i] ^ at[i]) & 0xFFFFFFFF) - (1 << 63)
        columns = [route, known, anchor, h[:, 0], h[:, 1], left, right, k0, k1, at.astype(np.int32), (ends - first).astype(np.int32)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns],
            names=["route", "known", "anchor", "h1", "h2", "left", "right", "k0", "k1", "at", "size"],
        )

    return map_texts(docs.select("k0", "k1", "text"), run, f"route long, known boolean, {_SEGMENT}", STEP)


def heavy_segments(docs: DataFrame) -> dict:
    """Rows of the most frequent segments of a sample: (h1, h2) -> (k0, k1, at) of one of them.

    Bounded by HEAVY entries. Each is seen twice, so it repeats for certain; what the sample
    misses takes the ordinary way to the same result.
    """
    part = docs.where(F.pmod(F.xxhash64(F.lit("heavy"), "k0", "k1"), F.lit(HEAVY_PART)) == 0)
    top = (
        segments(part)
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k0", "k1", "at")).alias("row"))
        .where("n >= 8")
        .orderBy(F.desc("n"), "h1", "h2")
        .limit(HEAVY)
    )
    return {(x["h1"], x["h2"]): tuple(x["row"]) for x in top.collect()}


def meet(rows: DataFrame) -> DataFrame:
    """Segments that share their anchor: (anchor, k0, k1, at, size, whole, compare).

    ``whole``: the same segment occurs elsewhere, all its bytes go. ``compare``: the first
    row of each different segment that agrees with another under its anchor on one side.
    """
    names = ["route", "known", "anchor", "h1", "h2", "left", "right"]

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            route, anchor = (table.column(c).to_numpy() for c in ("route", "anchor"))
            same = (route == route[-1]) & (anchor == anchor[-1])
            done = len(route) - int(same.sum())
            if done:
                yield marks(table.slice(0, done))
            rest = table.slice(done)
        if rest is not None:
            yield marks(rest)

    def marks(table):
        c = {n: table.column(n).to_numpy() for n in names}
        n = len(c["route"])
        group = np.append(True, (c["route"][1:] != c["route"][:-1]) | (c["anchor"][1:] != c["anchor"][:-1]))
        fresh = np.append(True, group[1:] | (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1]))
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, n))
        whole = np.repeat(sizes > 1, sizes) | c["known"]
        gid = np.cumsum(group) - 1
        compare = np.zeros(n, bool)
        for side in (c["left"][first], c["right"][first]):
            order = np.lexsort((side, gid[first]))
            g, v = gid[first][order], side[order]
            pair = (g[1:] == g[:-1]) & (v[1:] == v[:-1]) & (v[1:] != 0)
            compare[first[order[1:][pair]]] = True
            compare[first[order[:-1][pair]]] = True
        keep = np.flatnonzero(whole | compare)
        out = table.select(["anchor", "k0", "k1", "at", "size"]).take(pa.array(keep)).combine_chunks()
        arrays = [col.combine_chunks() for col in out.columns]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(whole[keep]), pa.array(compare[keep])], names=[*out.column_names, "whole", "compare"]
        )

    sorted_rows = rows.repartition("route").sortWithinPartitions("route", "anchor", "h1", "h2", "k0", "k1", "at")
    return sorted_rows.mapInArrow(run, "anchor long, k0 long, k1 int, at int, size int, whole boolean, compare boolean")


def repeated(shard: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """Starts in each segment whose ``span`` bytes also start elsewhere in the shard."""
    sizes = np.array([len(x) for x in shard])
    t = np.frombuffer(b"\0".join(shard) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 0
    order, lcp = suffix_order(t)
    owner = np.repeat(np.arange(len(shard)), sizes + 1)
    fits = ends[owner] - np.arange(len(t)) >= span
    near = (lcp[1:] >= span) & fits[order[1:]] & fits[order[:-1]]
    hit = np.zeros(len(t), bool)
    hit[order[1:][near]] = True
    hit[order[:-1][near]] = True
    places = np.flatnonzero(hit)
    begin = ends - sizes
    cuts = np.searchsorted(places, begin)
    return [places[a:b] - s for a, b, s in zip(cuts, np.append(cuts[1:], len(places)), begin, strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fresh = np.append(True, starts[1:] > starts[:-1] + SPAN) if len(starts) else np.zeros(0, bool)
    first = starts[fresh]
    last = starts[np.append(np.flatnonzero(fresh)[1:], len(starts)) - 1] if len(starts) else first
    return first, last + SPAN


def sort_shards(pieces: DataFrame) -> DataFrame:
    """Spans (k0, k1, at, size) that repeat among segments (anchor, k0, k1, at, bytes) of one anchor.

    Segments of an anchor stand together in a partition and are sorted with others in
    shards of SHARD_BYTES; an anchor with more is one larger shard, whose queues and
    arrays go to disk.
    """

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "k0", "k1", "at", "bytes")], strict=True):
                if size > SHARD_BYTES and row[0] != last:
                    yield from spans(held)
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[4])
        if held:
            yield from spans(held)

    def spans(held):
        out = []
        for (_, k0, k1, at, _), starts in zip(held, repeated([r[4] for r in held]), strict=True):
            for s, e in zip(*_runs(starts), strict=True):
                out.append((k0, k1, at + int(s), int(e - s)))
        if out:
            k0, k1, at, size = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k0, pa.int64()), pa.array(k1, pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32())],
                names=["k0", "k1", "at", "size"],
            )

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "k0 long, k1 int, at int, size int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k0, k1, spans): per document of ``docs`` (k0, k1, text) with repeats, (at, size) of repeated strings.

    Spans may overlap. Strings of SPAN bytes meet through anchors, so that each shard holds
    all it has to compare and no shard holds the corpus. Copies of a whole segment are
    marked when they meet, and one of each goes on: the suffix sort then finds what
    different segments share.
    """
    marked = cut(meet(segments(docs, heavy_segments(docs))))
    wanted = marked.where("compare").groupBy("k0", "k1").agg(F.collect_set(F.struct("anchor", "at", "size")).alias("pieces"))

    def read(batch):
        offsets, data = raw(batch.column("text"))
        buffer = memoryview(np.ascontiguousarray(data))
        rows = []
        for i, pieces in enumerate(batch.column("pieces").to_pylist()):
            k0, k1 = batch.column("k0")[i].as_py(), batch.column("k1")[i].as_py()
            for p in pieces:
                s = int(offsets[i]) + p["at"]
                rows.append((p["anchor"], k0, k1, p["at"], bytes(buffer[s : s + p["size"]])))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "k0", "k1", "at", "bytes"]
        )

    once = docs.select("k0", "k1", "text").join(wanted, ["k0", "k1"])
    # Rows of equal id and text give the same pieces again; one of them is enough.
    pieces = map_texts(once, read, "anchor long, k0 long, k1 int, at int, bytes binary")
    found = cut(sort_shards(pieces.dropDuplicates(["anchor", "k0", "k1", "at"])))
    spans = marked.where("whole").select("k0", "k1", "at", "size").unionByName(found)
    # Rows of equal id and text have equal spans; sets hold each once, before the shuffle already.
    return spans.groupBy("k0", "k1").agg(F.collect_set(F.struct("at", "size")).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["at"], x["at"] + x["size"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of ``docs``.

    Each byte covered by a string of SPAN bytes that also starts elsewhere goes, the same
    document included; strings are judged on the input. Null is the empty text. Every row
    counts as a document of its own: of two rows with equal id and text, both are
    repeated if they are long enough. Extra columns are not read, an empty table gives
    no rows.
    """
    kept = docs.select("doc_id", *key_columns(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spans = repeated_spans(kept.select("k0", "k1", "text"))
    joined = kept.join(spans, ["k0", "k1"], "left").select("doc_id", "text", "spans")

    def run(batch):
        offsets, data = raw(batch.column("text"))
        buffer = memoryview(np.ascontiguousarray(data))
        n_removed, n_spans, digests, merged = [], [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            at, base, h = 0, int(offsets[i]), hashlib.sha256()
            runs = _merged(spans or [])
            for s, e in runs:
                h.update(buffer[base + at : base + s])
                at = e
            h.update(buffer[base + at : int(offsets[i + 1])])
            n_removed.append(sum(e - s for s, e in runs))
            n_spans.append(len(runs))
            digests.append(h.hexdigest())
            merged.append([{"at": s, "size": e - s} for s, e in runs])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(merged, kind),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(
        joined, run,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<at:int,size:int>>",
    )

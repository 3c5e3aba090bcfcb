"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import cut, discard, map_texts, raw, row_key
from plotweave.operators.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Buckets up to this size compare their members; a larger one hands them to the whole-word ball.
SMALL = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash over the word shingles of UTF-8 text, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Fewer words
    than ``width`` make one shingle; no words give zero. A bit is set if it is set in
    over half of the hashes.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long, per row of ``docs``."""

    def run(batch):
        offsets, data = raw(batch.column("text"))
        data, at = data.tobytes(), offsets.tolist()
        fps = np.array([fingerprint(data[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], np.uint64)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs.select(*keep, "text"), run, f"{fields}, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of up to ``radius`` of the low ``bits`` bits, as unsigned words."""
    masks = [0] + [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]
    return np.array(masks, np.uint64)


def _spread(fps: DataFrame) -> DataFrame:
    """The few bytes of each fingerprint become many rows, so they are dealt to all tasks first."""
    return fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _pairs_of(sizes: np.ndarray, fps: np.ndarray, radius: int):
    """Linked pairs inside sorted buckets of at most SMALL members, shift by shift."""
    n = len(fps)
    ends = np.repeat(np.cumsum(sizes), sizes)
    for shift in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(np.arange(n) + shift < ends)
        a, b = fps[i], fps[i + shift]
        near = np.bitwise_count(a ^ b) <= radius
        yield a[near & (a != b)], b[near & (a != b)]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = 2) -> DataFrame:
    """Pairs (u, v) of fingerprints at most ``radius`` bits apart, enough of them to join every group of links.

    ``fps`` holds distinct values of ``fp``. Meet in the middle: of two words within the
    radius, each has a variant within half the radius that the other has, too. With
    ``blocks`` = 1 a fingerprint emits all 2081 variants of its 64 bits. With ``blocks`` = 2
    one 32-bit half must lie within radius // 2, so it emits the variants of each half
    within half of that, rounded up, of it: 66 rows for radius 4. They are shuffled on (half, variant); members
    of a bucket are verified on all 64 bits. A bucket of over SMALL members, as a large
    group of near copies makes, is not compared: its members emit the variants of the
    whole word, on which any two that meet are linked without comparing, so each bucket
    is a star. Work stays in proportion to rows for groups of every size.
    """
    if radius % 2:
        raise ValueError("the radius must be even: only then two words that share a variant of the whole word are within it")
    if blocks == 1:
        return _whole(fps, radius)
    masks = ball(32, -(-(radius // 2) // 2))
    both = np.concatenate([masks, masks << np.uint64(32)])
    kinds = np.repeat(np.arange(2, dtype=np.int8), len(masks))

    def emit(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(fp), 4096):
                x = fp[start : start + 4096]
                v = x[:, None] ^ both[None]
                half = np.where(kinds[None] == 0, v & np.uint64(0xFFFFFFFF), v >> np.uint64(32))
                key = (half << np.uint64(1)) | kinds[None].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(x, len(both)).view(np.int64))], names=["key", "fp"]
                )

    def meet(batches):
        carry = np.zeros((2, 0), np.int64)
        large = None  # key of a large bucket that goes on in the next batch
        for batch in batches:
            got = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp")])
            rows = np.concatenate([carry, got], axis=1)
            last = rows[0, -1]
            done = int(np.searchsorted(rows[0], last))
            tail = rows[:, done:]
            carry = tail
            out, large = bucket(rows[:, :done], large)
            yield out
            if tail.shape[1] > SMALL:  # members of a large bucket need not wait for the rest
                out, large = bucket(tail, large, open_end=True)
                yield out
                carry = tail[:, :0]
        yield bucket(carry, large)[0]

    def bucket(rows, large, open_end=False):
        key, fp = rows[0], np.ascontiguousarray(rows[1]).view(np.uint64)
        if not len(key):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(key)], names=["u", "v"]), large
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        hot = sizes > SMALL
        if large is not None and key[0] == large:
            hot[0] = True
        hot_rows = np.repeat(hot, sizes)
        us, vs = [fp[hot_rows]], [fp[hot_rows]]
        cold = ~hot_rows
        if cold.any():
            for u, v in _pairs_of(sizes[~hot], fp[cold], radius):
                us.append(u)
                vs.append(v)
        u, v = (np.concatenate(x).view(np.int64) for x in (us, vs))
        now = key[-1] if open_end else None
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"]), now

    variants = _spread(fps).mapInArrow(emit, "key long, fp long")
    met = cut(variants.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long").distinct())
    found = met.where("u <> v")
    rest = met.where("u = v").select(F.col("u").alias("fp")).distinct()
    return found.unionByName(_whole(rest, radius))


def _whole(fps: DataFrame, radius: int) -> DataFrame:
    """Stars (smallest member, member) of the buckets of whole-word variants within half the radius."""
    masks = ball(64, radius // 2)

    def emit(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(fp), 64):
                x = fp[start : start + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((x[:, None] ^ masks[None]).ravel().view(np.int64)), pa.array(np.repeat(x, len(masks)).view(np.int64))],
                    names=["variant", "fp"],
                )

    variants = _spread(fps).mapInArrow(emit, "variant long, fp long")
    # A window, not a join with the minima: the optimizer takes what a fingerprint emits for as small as the fingerprint,
    # and would broadcast it. A variant has as many members as masks at most, since fingerprints are distinct.
    low = F.min("fp").over(Window.partitionBy("variant"))
    return variants.select(F.col("fp").alias("u"), low.alias("v")).where("u <> v").distinct()


def classes(fps: DataFrame, radius: int = RADIUS, blocks: int = 2) -> DataFrame:
    """(fp, class): the smallest fingerprint reachable by links, for every distinct ``fp``."""
    edges = cut(links(fps, radius, blocks))
    parts = connected_components(edges)
    joined = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select("fp", F.coalesce("component", "fp").alias("class"))


def simhash(docs: DataFrame, radius: int = RADIUS, blocks: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    component_id is the smallest doc_id among the documents whose fingerprints are
    reachable by links of at most ``radius`` differing bits. Null and empty texts have
    fingerprint zero, which links like any other. Null ids take no part in the minimum;
    a group of null ids only has a null component_id. Repeated rows get equal answers,
    extra columns are not read, an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, ["doc_id"]))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    named = cut(classes(groups.select("fp"), radius, blocks))
    lows = groups.join(named, "fp")
    first = lows.groupBy("class").agg(F.min("low").alias("component_id"))
    answer = lows.join(first, "class").select(F.col("fp").alias("fp_"), "component_id")
    return rows.join(answer, F.col("fp") == F.col("fp_")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS, blocks: int = 2) -> DataFrame:
    """``docs`` with one document of each group of linked fingerprints: the smallest id, null last.

    Ties of id go to the smaller text hash; of rows with equal id and text one stays.
    """
    rows = cut(fingerprints(docs.select("text", *row_key()), ["k0", "k1", "k2"]))
    null_last = (F.col("k0") == -(1 << 62)).alias("no_id")
    best = F.min(F.struct(null_last, "k0", "k1", "k2"))
    groups = cut(rows.groupBy("fp").agg(best.alias("low")))
    named = cut(classes(groups.select("fp"), radius, blocks))
    kept = groups.join(named, "fp").groupBy("class").agg(F.min("low").alias("low")).select("low.k0", "low.k1", "low.k2")
    counted = cut(
        rows.groupBy("k0", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).join(kept, ["k0", "k1", "k2"], "left_semi")
    )
    discard(rows)
    keys = [c.alias(f"simhash_{name}") for c, name in zip(row_key(), ("k0", "k1", "k2"), strict=True)]
    marked = docs.select(*docs.columns, *keys)

    def chosen(wanted: DataFrame) -> DataFrame:
        keys = wanted.select(*[F.col(k).alias(f"simhash_{k}") for k in ("k0", "k1", "k2")])
        return marked.join(keys, keys.columns, "left_semi")

    single = chosen(counted.where("n = 1")).select(*docs.columns)
    several = chosen(counted.where("n > 1"))
    return single.unionByName(several.dropDuplicates([c for c in several.columns if c.startswith("simhash_k")]).select(*docs.columns))

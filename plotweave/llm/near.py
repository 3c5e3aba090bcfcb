"""One document of each group of near copies: SimHash tables met in the middle, verified by word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import cut, discard, map_texts, raw, row_key
from plotweave.llm.simhash import SEED, _LOWER, ball
from plotweave.operators.components import connected_components

#: Words in a shingle, and the part of two texts' distinct shingles that near copies share at least.
WIDTH, SIMILARITY = 5, 0.8
#: The 128 bits of a fingerprint give TABLES words of BITS bits; copies agree in one of them up to two bits. A
#: fingerprint meets about N * 1e-4 unrelated ones among N; from some ten million different texts on, take wider words.
TABLES, BITS = 6, 21
#: Copies differ in at most this many of the 128 bits before their shingles are compared.
RADIUS = 26
#: Members of a bucket that one step compares; a larger bucket is cut in tiles of half of it, and each two tiles meet.
SMALL = 4096
#: Shingles that a tile of a group holds, each member counting as OWN more; a larger group is cut in tiles, and each two tiles meet.
TILE, OWN = 1 << 20, 512

_KEY = ["k0", "k1", "k2"]


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of words between ASCII white space, A-Z in lower case; fewer words make one shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), np.uint64, n)


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits, as two words: a bit is set if over half of the hashes, or of hashes of them, have it."""
    out = []
    for k in range(2):
        x = h if k == 0 else (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x if k == 0 else x ^ (x >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(x)).tobytes(), "big"))
    return out[0], out[1]


def _fingerprints(docs: DataFrame, width: int) -> DataFrame:
    def run(batch):
        offsets, data = raw(batch.column("text"))
        data, at = data.tobytes(), offsets.tolist()
        hashes = [shingles(data[s:e], width) for s, e in zip(at[:-1], at[1:], strict=True)]
        words = np.array([fingerprint(h) for h in hashes], np.uint64).reshape(-1, 2).view(np.int64)
        sizes = pa.array([len(h) for h in hashes], pa.int32())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in _KEY], pa.array(words[:, 0]), pa.array(words[:, 1]), sizes], names=[*_KEY, "w0", "w1", "n"]
        )

    return map_texts(docs.select(*_KEY, "text"), run, "k0 long, k1 long, k2 long, w0 long, w1 long, n int")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(a[0] ^ b[0]).astype(np.int64) + np.bitwise_count(a[1] ^ b[1])).astype(np.int64)


def _word(w0: np.ndarray, w1: np.ndarray, table: int) -> np.ndarray:
    p = table * BITS
    word = w0 >> np.uint64(p) if p < 64 else w1 >> np.uint64(p - 64)
    if p < 64 < p + BITS:
        word = word | (w1 << np.uint64(64 - p))
    return word & np.uint64((1 << BITS) - 1)


def forest(w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, i, j, d): least spanning forests of the links i < j of ``w`` (2 words, groups, members), all groups at once.

    Links are ordered by distance, then i, then j; each step adds the nearest member to a group's tree, or starts another one.
    """
    _, m, n = w.shape
    far, done, each, at = (radius + 1) * n * n, (radius + 2) * n * n, np.arange(m), np.arange(n)
    best, last = np.full((m, n), far, np.int64), np.zeros(m, np.int64)
    found = []
    for _ in range(n - 1):
        best[each, last] = done
        here, old = last[:, None], w[:, each, last][:, :, None]
        d = _apart(w, old)
        link = np.where(d > radius, far, d * (n * n) + np.minimum(here, at) * n + np.maximum(here, at))
        np.minimum(best, link, out=best, where=best < done)
        last = best.argmin(axis=1)
        link = best[each, last]
        near = link < far
        found.append((each[near], link[near]))
    group, link = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return group, link // n % n, link % n, link // (n * n)


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u0, u1, v0, v1, d): links u < v between fingerprints (w0, w1) of ``nodes`` (w0, w1, n; distinct) at most ``radius`` bits apart that meet.

    Each fingerprint emits, for every table, its word and all words one bit away, so two
    that differ in at most two bits of a table share a variant. The key also has the
    octave of the number of shingles, whose borders are shifted from table to table.

    All members of a bucket are compared. Of a bucket's links its least spanning forest is
    given, in the order of distance, u and v, which is the same everywhere: a link left out is
    the last one of a circle of links, so the groups and the first link of each fingerprint
    are those of all links. Buckets above ``SMALL`` are dealt out in pairs of tiles. ``keep_one``
    takes only the groups from here, and compares the shingles of all members of a group.
    """
    masks, limit = ball(BITS, 1), SMALL

    def emit(batches):
        for batch in batches:
            w0, w1 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("w0", "w1"))
            octave = np.log2(batch.column("n").to_numpy(zero_copy_only=False) + 1.0)
            for at in range(0, len(w0), 4096):
                a, b = w0[at : at + 4096], w1[at : at + 4096]
                for t in range(TABLES):
                    kind = np.uint64(t * 64) + (octave[at : at + 4096] + t / TABLES).astype(np.uint64)
                    key = (kind << np.uint64(BITS))[:, None] | (_word(a, b, t)[:, None] ^ masks[None])
                    many = len(masks)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (key.ravel(), np.repeat(a, many), np.repeat(b, many))], names=["key", "w0", "w1"]
                    )

    def bits(rows):
        """Of each member, the bit in which its word differs from the bucket's, or 0."""
        out = np.zeros(rows.shape[1], np.uint64)
        for t in range(TABLES):
            own = np.flatnonzero(rows[0] >> np.uint64(BITS + 6) == np.uint64(t))
            out[own] = rows[0, own] & np.uint64((1 << BITS) - 1) ^ _word(rows[1, own], rows[2, own], t)
        return out

    def linked(rows, starts, sizes):
        out = [np.zeros((5, 0), np.int64)]
        for n in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == n][:, None] + np.arange(n)
            w = rows[1:][:, at]
            group, i, j, d = forest(w, radius)
            out.append(np.concatenate([w[:, group, i].view(np.int64), w[:, group, j].view(np.int64), d[None]]))
        return np.concatenate(out, axis=1)

    def meet(batches):
        held, large = np.zeros((3, 0), np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "w0", "w1")])
            rows = np.concatenate([held, got], axis=1)
            starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            yield from settled(rows[:, : starts[-1]], starts[:-1], large)
            held = rows[:, starts[-1] :]
            if held.shape[1] > limit or held[0, 0] == large:  # need not wait for the rest of the bucket
                large = held[0, 0]
                yield handed_on(held)
                held = held[:, :0]
        yield from settled(held, np.zeros(min(1, held.shape[1]), np.int64), large)

    def settled(rows, starts, large):
        if not len(starts):
            return
        sizes, bit = np.diff(np.append(starts, rows.shape[1])), bits(rows)
        more = (sizes > limit) | ((rows[0, starts] == large) if large is not None else False)
        if more.any():
            yield handed_on(rows[:, np.repeat(more, sizes)])
        # Members that all differ from the bucket's word in the same bit have one word, and meet in its bucket.
        low, high = np.minimum.reduceat(bit, starts), np.maximum.reduceat(bit, starts)
        use = ~more & ((low == 0) | (low < high))
        links = linked(rows, starts[use], sizes[use])
        none = pa.nulls(links.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *[pa.array(x) for x in links]], names=["key", "bit", "u0", "u1", "v0", "v1", "d"])

    def handed_on(rows):
        none = pa.nulls(rows.shape[1], pa.int64())
        key, w0, w1, bit = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*rows, bits(rows)))
        return pa.RecordBatch.from_arrays([key, bit, w0, w1, none, none, none], names=["key", "bit", "u0", "u1", "v0", "v1", "d"])

    def meet_tiles(batches):
        held = np.zeros((3, 0), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "w0", "w1")])
            rows = np.concatenate([held, got], axis=1)
            starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            done, held = rows[:, : starts[-1]], rows[:, starts[-1] :]
            yield packed(linked(done, starts[:-1], np.diff(starts)))
        if held.shape[1]:
            yield packed(linked(held, np.zeros(1, np.int64), np.array([held.shape[1]])))

    def packed(links):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in links], names=["u0", "u1", "v0", "v1", "d"])

    spread = nodes.select("w0", "w1", "n").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w0", "w1")
    variants = spread.mapInArrow(emit, "key long, w0 long, w1 long")
    link = "u0 long, u1 long, v0 long, v1 long, d long"
    met = cut(variants.repartition("key").sortWithinPartitions("key", "w0", "w1").mapInArrow(meet, f"key long, bit long, {link}"))
    links = met.where("key IS NULL").drop("key", "bit")
    rest = met.where("key IS NOT NULL").select("key", "bit", F.col("u0").alias("w0"), F.col("u1").alias("w1"))
    if rest.isEmpty():
        return links.distinct()
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("bit").alias("low"), F.max("bit").alias("high"))
    sizes = sizes.where("low = 0 OR low < high").select("key", F.ceil(2 * F.col("n") / limit).alias("tiles"))
    dealt = rest.drop("bit").join(sizes, "key").withColumn("tile", F.expr("pmod(xxhash64(w0, w1), tiles)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    pair = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    tiles = dealt.select(pair.alias("key"), "w0", "w1").repartition("key").sortWithinPartitions("key", "w0", "w1")
    return links.unionByName(tiles.mapInArrow(meet_tiles, link)).distinct()


def alike(w: np.ndarray, sets: list[np.ndarray], radius: int = RADIUS, similarity: float = SIMILARITY) -> np.ndarray:
    """Of each member, with words ``w`` (2, members) and sorted shingles, the first one that links lead to.

    Any two members are linked if they are at most ``radius`` bits apart and share ``similarity`` of their distinct
    shingles. Two that are joined already need no comparison, nor do two whose sizes alone rule it out.
    """
    root, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        low, high = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
        near = later[(root[later] != root[i]) & (low >= similarity * high)]
        near = near[_apart(w[:, near], w[:, i : i + 1]) <= radius]
        if not len(near):
            continue
        n = sizes[near]
        others = np.concatenate([sets[j] for j in near])
        found = sets[i][np.minimum(np.searchsorted(sets[i], others), sizes[i] - 1)] == others
        common = np.add.reduceat(found, np.cumsum(n) - n, dtype=np.int64)
        linked = near[common >= similarity * (sizes[i] + n - common)]
        joined = np.isin(root, root[np.append(linked, i)])
        root[joined] = root[joined].min()
    return root


def _alike_links(members: DataFrame, plain: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """(u, v): links that join all ``members`` (component, node, w0, w1, n, and the key of a text in ``plain``) of a component that are alike."""
    sizes = members.groupBy("component").agg(F.ceil(F.sum(F.col("n") + OWN) / TILE).alias("tiles"))
    tiled = members.join(sizes, "component").withColumn("tile", F.expr("pmod(node, tiles)"))
    texts = plain.join(tiled.drop("n"), _KEY).drop(*_KEY).dropDuplicates(["node"])
    kept = ["component", "node", "w0", "w1", "tiles", "tile"]

    def sets(batch):
        offsets, data = raw(batch.column("text"))
        data, at = data.tobytes(), offsets.tolist()
        hashes = [np.unique(shingles(data[s:e], width).view(np.int64)) for s, e in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(hashes, pa.list_(pa.int64()))], names=[*kept, "held"])

    def compare(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = table.column("key").to_numpy()
            last = int(np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, 0).max())  # the last group may go on
            if last:
                yield compared(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield compared(held)

    def compared(table):
        key, node, w0, w1 = (table.column(c).to_numpy() for c in ("key", "node", "w0", "w1"))
        lists = table.column("held").combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        held, w = [values[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], np.stack([w0, w1]).view(np.uint64)
        root = np.arange(len(key))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
            root[s:e] = s + alike(w[:, s:e], held[s:e], radius, similarity)
        moved = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["u", "v"])

    fields = ", ".join(f"{c} long" for c in kept)
    dealt = map_texts(texts.select(*kept, "text"), sets, f"{fields}, held array<long>")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).where("tiles = 1 OR tile <> other")
    key = F.xxhash64("component", F.least("tile", "other"), F.greatest("tile", "other"))
    dealt = dealt.select(key.alias("key"), "node", "w0", "w1", "held")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(compare, "u long, v long")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near copies: the smallest id, null last, then text hash.

    Near copies are at most ``radius`` bits apart and share ``similarity`` of their distinct
    shingles, so a chance meeting of bits drops nothing. Any two members of a component of
    ``near_links`` are compared; groups are the components of the near copies among them,
    and one of each group stays. Texts without words are copies of each other;
    null counts as empty. Of rows with equal id and text one stays, all columns are kept,
    an empty table gives no rows.
    """
    plain = docs.select("text", *row_key())
    rows = cut(_fingerprints(plain, width))
    order = F.struct((F.col("k0") == -(1 << 62)).alias("no_id"), *_KEY)
    nodes = cut(rows.groupBy("w0", "w1").agg(F.min(order).alias("low"), F.max("n").alias("n")).withColumn("node", F.xxhash64("w0", "w1")))
    found = near_links(nodes, radius)
    links = cut(found.select(F.xxhash64("u0", "u1").alias("u"), F.xxhash64("v0", "v1").alias("v")))
    parts = cut(connected_components(links))
    members = nodes.join(parts, "node").select("component", "node", "w0", "w1", F.col("n").cast("long").alias("n"), *[f"low.{k}" for k in _KEY])
    copies = cut(connected_components(_alike_links(cut(members), plain, width, similarity, radius)))
    joined = nodes.join(copies, "node").select("node", "low", "component")
    first = joined.groupBy("component").agg(F.min("low").alias("first"))
    gone = joined.join(first, "component").where("low <> first").select("node")
    kept = nodes.join(gone, "node", "left_anti").select(*[F.col(f"low.{k}").alias(f"near_{k}") for k in _KEY])
    discard(rows)
    keys = [c.alias(f"near_{name}") for c, name in zip(row_key(), _KEY, strict=True)]
    chosen = docs.select(*docs.columns, *keys).join(cut(kept), [f"near_{k}" for k in _KEY], "left_semi")
    # Rows of equal id and text are told apart by nothing else; one stays.
    return chosen.dropDuplicates([f"near_{k}" for k in _KEY]).select(*docs.columns)

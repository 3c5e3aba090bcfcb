"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import cut, map_texts

#: Words of a window, and the share of an item's windows a document must hold.
WINDOW, SHARE = 5, 0.8
#: Up to so many different windows of the benchmark are sent to the tasks to sieve with (8 bytes each).
SIEVE = 1 << 20

# Words that are units when a number stands before them.
UNITS = frozenset(
    """mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons
    oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes
    h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees
    meter meters metre metres kilometer kilometers kilometre kilometres mph kmh""".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:%|([A-Za-z]{1,10}))?")
_EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
LITERAL, NUMBER, UNIT, NAME = range(4)


class Words(dict):
    """word -> kind in the upper bits and a hash of the literal in the lower 60, or -1; kept small by starting afresh."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        core = word if word.isalpha() else _EDGES.sub("", word)
        folded = core.casefold()
        kind = LITERAL
        if not core.isalpha() and (number := _NUMBER.fullmatch(core)) and (not number[1] or number[1].lower() in UNITS):
            kind = NUMBER
        elif folded in UNITS:
            kind = UNIT
        elif core[:1].isupper() and not core.isupper():
            kind = NAME
        known = core.isalnum() or any(map(str.isalnum, core))
        code = kind << 60 | xxhash.xxh3_64_intdigest(folded) >> 4 if known else -1
        self[word] = code
        return code


_words = Words()
_rng = np.random.default_rng(23)
_PLACE = _rng.integers(1 << 61, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)


def canonical(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, literal hash) of the words of some texts; words without a letter or digit are left out.

    In a template numbers, the units after them and capitalised words are placeholders of
    their type; other words stand for themselves, in lower case and without punctuation
    around them. A word that looks like a unit but follows no number is a literal.
    """
    words = [(text or "").split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    if (code < 0).any():
        row, code = row[code >= 0], code[code >= 0]
    kind = code >> 60
    unit = np.flatnonzero(kind == UNIT)
    stray = (unit == 0) | (kind[unit - 1] != NUMBER) | (row[unit - 1] != row[unit])
    kind[unit[stray]] = LITERAL
    return row, kind, code & ((1 << 60) - 1)


def window_hashes(row: np.ndarray, kind: np.ndarray, value: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the windows of ``width`` words that lie in one row, in three families.

    The first has placeholders for numbers and units only, so that case does not matter.
    The second has them for names, too; its windows hold a name and keep two literals at
    least, for placeholders alone say nothing. Windows of next to nothing but numbers make
    the third, in which the values themselves must agree.
    """
    n = len(kind) - width + 1
    if n <= 0:
        return []
    inside = row[:n] == row[width - 1 :]

    def rolled(x, seed, places):
        every = 4 * len(places) > n  # slices are cheaper than picking most of the places
        h = np.full(n if every else len(places), seed, np.uint64)
        for k in range(width):
            h += (x[k : k + n] if every else x[places + k]) * _PLACE[k % 64]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h[places] if every else h).view(np.int64)

    def count(mask):
        c = np.append(0, np.cumsum(mask))
        return c[width:] - c[:-width]

    literal, name = kind == LITERAL, kind == NAME
    n_literal, n_name = count(literal), count(name)
    plain = np.where(literal | name, value, kind).view(np.uint64)
    named = np.where(literal, value, kind).view(np.uint64)
    enough = n_literal + n_name >= 2
    out = []
    for x, seed, mask in ((plain, 1, enough), (named, 101, (n_name > 0) & (n_literal >= 2)), (value.view(np.uint64), 201, ~enough)):
        places = np.flatnonzero(inside & mask)
        if len(places):
            out.append((places, rolled(x, seed + width, places)))
    return out


def template_windows(df: DataFrame, key: str, widths: list[int], sieve: np.ndarray | None = None) -> DataFrame:
    """(key, w, at, kinds, slots): windows of the texts of ``df``; ``slots`` are hashes of all words of the window.

    With ``sieve``, sorted window hashes, only windows in it are given.
    """
    if sieve is not None:
        marks = np.zeros(1 << 20, bool)
        marks[(sieve & ((1 << 20) - 1))] = True

    def run(batch):
        row, kind, value = canonical(batch.column("text").to_pylist())
        first = np.searchsorted(row, np.arange(batch.num_rows))
        parts = []
        for width in widths:
            for at, h in window_hashes(row, kind, value, width):
                if sieve is not None:
                    ok = marks[h & ((1 << 20) - 1)]
                    at, h = at[ok], h[ok]
                    ok = sieve[np.minimum(np.searchsorted(sieve, h), len(sieve) - 1)] == h if len(sieve) else np.zeros(len(h), bool)
                    at, h = at[ok], h[ok]
                if len(at):
                    cells = at[:, None] + np.arange(width)
                    columns = [pa.array(x[cells].ravel()) for x in (kind, value)]
                    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
                    lists = [pa.ListArray.from_arrays(ends, c) for c in columns]
                    place = pa.array((at - first[row[at]]).astype(np.int32))
                    parts.append(pa.RecordBatch.from_arrays(
                        [batch.column(key).take(pa.array(row[at])), pa.array(h), place, *lists], names=[key, "w", "at", "kinds", "slots"]
                    ))
        return pa.Table.from_batches(parts) if parts else None

    kind = df.schema[key].dataType.simpleString()
    return map_texts(df.select(key, "text"), run, f"{key} {kind}, w long, at int, kinds array<bigint>, slots array<bigint>")


def _lengths(benchmark: DataFrame) -> DataFrame:
    """(item_id, n): words of each item, from one up."""

    def run(batch):
        n = np.bincount(canonical(batch.column("text").to_pylist())[0], minlength=batch.num_rows).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("item"), pa.array(n, pa.int32())], names=["item", "n"])

    return map_texts(benchmark.select("item", "text"), run, "item long, n int").where("n > 0")


def settled(windows: list[tuple[int, list[dict]]]) -> list[int]:
    """Places of the windows (place, slot pairs a -> b of kind k) of one offset that go together.

    Windows vote for their pairs, unless they contradict themselves. Pairs are taken by
    votes, on ties equal values first, as long as slots still map one to one. Windows of
    taken pairs stay, and so do those that agree word for word.
    """
    groups = []
    for at, slots in windows:
        pairs = {(p["k"], p["a"], p["b"]) for p in slots}
        same = all(a == b for _, a, b in pairs)
        if same or len({p[:2] for p in pairs}) == len(pairs) == len({p[::2] for p in pairs}):
            groups.append((at, pairs, same))
    votes = Counter(itertools.chain.from_iterable(pairs for _, pairs, _ in groups))
    there, back = {}, {}
    for k, a, b in sorted(votes, key=lambda p: (-votes[p], p[1] != p[2], p)):
        if (k, a) not in there and (k, b) not in back:
            there[k, a], back[k, b] = b, a
    return sorted({at for at, pairs, same in groups if same or all(there.get((k, a)) == b for k, a, b in pairs)})


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(key, item_id, share): documents that hold at least ``share`` of the windows of a benchmark item.

    Windows of ``width`` words of the templates join by hash; an item of fewer words is one
    window of its own length. Matches of one document and item at one offset must fill
    slots consistently: a number or name of the item always becomes the same one in the
    document, and different ones stay different. Windows that contradict the others of
    their offset are left out, see ``settled``; the rest are counted once each. The benchmark's hashes sieve the documents' windows in the tasks if
    there are at most SIEVE of them; a larger benchmark meets all windows in the join.
    """
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item"), "text").where("text IS NOT NULL AND item_id IS NOT NULL"))
    lengths = cut(_lengths(items).groupBy("item").agg(F.max("n").alias("n")))
    widths = [x["w"] for x in lengths.select(F.least("n", F.lit(width)).alias("w")).distinct().orderBy("w").collect()]
    spark = docs.sparkSession
    if not widths:
        return spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, item_id long, share double")
    parts = []
    for w in widths:
        own = items.join(lengths.where(F.least("n", F.lit(width)) == w), "item", "left_semi")
        parts.append(template_windows(own, "item", [w]))
    theirs = parts[0]
    for p in parts[1:]:
        theirs = theirs.unionByName(p)
    theirs = cut(theirs.distinct().withColumnsRenamed({"at": "item_at", "slots": "item_slots", "kinds": "item_kinds"}))
    hashes = theirs.select("w").distinct()
    sieve = None
    if hashes.count() <= SIEVE:
        sieve = np.sort(hashes.toArrow().column("w").to_numpy())
    ours = template_windows(docs, key, widths, sieve)
    pairs = (
        ours.join(theirs, "w")
        .withColumn("pairs", F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"), F.col("item_kinds").alias("k")))
        .withColumn("pairs", F.filter("pairs", lambda p: p["k"] != LITERAL))
    )
    found = pairs.groupBy(key, "item", (F.col("at") - F.col("item_at")).alias("offset")).agg(
        F.collect_set(F.struct(F.col("item_at").alias("at"), "pairs")).alias("windows")
    )
    total = F.greatest(F.col("n") - width + 1, F.lit(1))
    found = found.join(lengths, "item").select(
        key, "item", total.alias("total"), "windows", F.array_distinct("windows.at").alias("places"),
        F.array_distinct(F.flatten("windows.pairs")).alias("pairs"),
    )
    # Pairs of too few windows at all offsets together need no look at their slots.
    found = found.withColumn("most", F.sum(F.size("places")).over(Window.partitionBy(key, "item")))
    n = F.size("pairs")
    one_way = F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["a"], p["k"])))) == n
    other_way = F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["b"], p["k"])))) == n
    found = cut(found.where(F.col("most") / F.col("total") >= share).withColumn("consistent", one_way & other_way))

    def settle(batches):
        for batch in batches:
            places = [settled([(x["at"], x["pairs"]) for x in group]) for group in batch.column("windows").to_pylist()]
            columns = [*[batch.column(c) for c in (key, "item", "total")], pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "item", "total", "places"])

    plain = found.where("consistent").select(key, "item", "total", "places")
    mixed = found.where("NOT consistent").select(key, "item", "total", "windows")
    mixed = mixed.mapInArrow(settle, f"{key} {docs.schema[key].dataType.simpleString()}, item long, total int, places array<int>")
    held = plain.unionByName(mixed).groupBy(key, "item", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held")
    )
    scored = held.select(key, F.col("item").alias("item_id"), (F.col("held") / F.col("total")).alias("share"))
    return scored.where(F.col("share") >= share)


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share) for every document that holds a benchmark item; see ``contaminated``.

    Null ids and null or empty texts are in no pair. Rows of equal id count as one
    document. Extra columns are not read; empty tables give no rows.
    """
    return contaminated(docs.where("doc_id IS NOT NULL"), benchmark, "doc_id", width, share)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, all columns kept.

    Documents are told apart by text, so null or repeated ids do no harm.
    """
    keys = [F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "text")]
    texts = docs.where("text IS NOT NULL").select(F.concat_ws(":", *keys).alias("decontaminate_key"), "text")
    hit = cut(contaminated(texts, benchmark, "decontaminate_key", width, share).select("decontaminate_key").distinct())
    marked = docs.select(*docs.columns, F.concat_ws(":", *keys).alias("decontaminate_key"))
    return marked.join(hit, "decontaminate_key", "left_anti").select(*docs.columns)

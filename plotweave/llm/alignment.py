"""Alignment of two tokenizers over a corpus, with counts of linked ids by spilled runs and a heap merge."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import bound_batches, cut, raw

#: Folder of the vocabulary files on every machine, and the files of the two sides.
FOLDER, SIDE_A, SIDE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose records make one block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Id pairs in one chunk of a run, and entries that a merge gathers before it settles what it can.
CHUNK_PAIRS, OPEN_ENTRIES = 1 << 12, 1 << 20
#: Bytes of text that a tokenizer takes at once, unless one segment is longer.
ENCODE_BYTES = 1 << 18

_HEAD, _BODY, _DOC = 0, 1, 2
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Side:
    """One tokenizer: ids of a text, and each id's bytes as a flat table."""

    def __init__(self, names: list[bytes], encode):
        self.encode = encode
        self.splits = all(len(_segments(np.frombuffer(b"   " + x, np.uint8), np.zeros(1, np.int64), True)) == 1 for x in names if b" " in x)
        self.sizes = np.array([len(x) for x in names], np.int64)
        self.begin = np.append(0, np.cumsum(self.sizes))
        self.flat = np.frombuffer(b"".join(names) or b"\0", np.uint8)
        digits = [str(i).encode() + b"," for i in range(len(names))]
        self.digit_sizes = np.array([len(x) for x in digits], np.int64)
        self.digit_begin = np.append(0, np.cumsum(self.digit_sizes))
        self.digits = np.frombuffer(b"".join(digits), np.uint8)


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after another."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return flat[np.arange(total) + np.repeat(begin - stop + size, size)]


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its Latin-1 letter, the others as letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def side(path: str) -> Side:
    """The tokenizer of a file: byte-level JSON, or a sentence-piece model.

    ``splits`` says that no token reaches over a place where ``_segments`` cuts a text.
    """
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        tool.encode_special_tokens = True
        letters = _bytes_of_letters()
        names = [b""] * tool.get_vocab_size()
        for token, i in tool.get_vocab(with_added_tokens=True).items():
            names[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        fast = getattr(tool, "encode_batch_fast", tool.encode_batch)
        return Side(names, lambda text: np.array(fast([text], add_special_tokens=False)[0].ids, np.int64))
    from sentencepiece import SentencePieceProcessor

    tool = SentencePieceProcessor(model_file=path)
    pieces = [tool.id_to_piece(i) for i in range(tool.vocab_size())]
    names = [bytes([int(p[1:-1], 16)]) if tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    # The model puts a blank before every text, which stands for the first one here.
    return Side(names, lambda text: np.array(tool.encode(text[1:], num_threads=1) if text != " " else [], np.int64))


def _segments(data: np.ndarray, offsets: np.ndarray, splits: bool) -> np.ndarray:
    """Where segments begin: texts, and blanks behind a byte that no white space can end with."""
    start = np.zeros(len(data) + 1, bool)
    start[offsets] = True
    if splits and len(data) > 3:
        back = [np.concatenate([np.full(k, 32, np.uint8), data[:-k]]) for k in (1, 2, 3)]
        # Bytes 0x80 and up may end white space of two or three bytes: C2 .., E1 .. .., E2 .. .., E3 .. ..
        wide = (back[0] >= 128) & ((back[1] == 0xC2) | ((back[2] >= 0xE1) & (back[2] <= 0xE3)))
        start[:-1] |= (data == 32) & (back[0] > 32) & ~wide
    return np.flatnonzero(start[:-1])


def _tokens(tool: Side, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, bad): tokens of all segments, where they end in the joined segments, and which segments they don't spell."""
    sizes = np.array([len(s) for s in segments], np.int64)
    bad = np.zeros(len(segments), bool)
    ids, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stops = np.cumsum(sizes)

    def spelled(text: bytes, base: int, marks: np.ndarray) -> bool:
        try:
            got = tool.encode(text.decode())
        except UnicodeDecodeError:
            return False
        size = tool.sizes[got]
        if int(size.sum()) != len(text) or _gather(tool.flat, tool.begin[got], size).tobytes() != text:
            return False
        stop = np.cumsum(size) + base
        if len(marks) and not (stop[np.searchsorted(stop, marks)] == marks).all():
            return False
        ids.append(got)
        ends.append(stop)
        return True

    at = 0
    while at < len(segments):
        # Segments join as long as each ends with a visible character; others are read alone.
        stop, size = at, 0
        while stop < len(segments) and (stop == at or size + len(segments[stop]) <= ENCODE_BYTES):
            size += len(segments[stop])
            stop += 1
            last = segments[stop - 1][-3:]
            if last[-1] <= 32 or (last[-1] >= 128 and (last[-2] == 0xC2 or 0xE1 <= last[0] <= 0xE3)):
                break
        base = int(stops[at] - sizes[at])
        if not spelled(b"".join(segments[at:stop]), base, stops[at:stop]):
            for i in range(at, stop):
                bad[i] = not spelled(segments[i], int(stops[i] - sizes[i]), stops[i : i + 1])
        at = stop
    return np.concatenate(ids), np.concatenate(ends), bad


def align_segments(a: Side, b: Side, segments: list[bytes]) -> dict:
    """Tokens, groups and links of each of the distinct ``segments``; a bad one has none."""
    sizes = np.array([len(s) for s in segments], np.int64)
    stops = np.cumsum(sizes)
    ids_a, ends_a, bad_a = _tokens(a, segments)
    ids_b, ends_b, bad_b = _tokens(b, segments)
    bad = bad_a | bad_b
    good_a, good_b = (~bad[np.searchsorted(stops, e)] for e in (ends_a, ends_b))
    ids_a, ends_a, ids_b, ends_b = ids_a[good_a], ends_a[good_a], ids_b[good_b], ends_b[good_b]
    n = len(segments)
    home_a, home_b = np.searchsorted(stops, ends_a), np.searchsorted(stops, ends_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    # Each token of A overlaps the tokens of B from the first that ends behind its start to the first that reaches its end.
    first = np.searchsorted(ends_b, ends_a - a.sizes[ids_a], "right")
    count = np.searchsorted(ends_b, ends_a, "left") - first + 1
    link_b = ids_b[_gather(np.arange(len(ids_b)), first, count)] if len(ids_a) else ids_b[:0]
    link_a, home = np.repeat(ids_a, count), np.repeat(home_a, count)
    # Text of the groups: A ids, a bar, B ids, a semicolon; a comma between ids of one side.
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    size = np.concatenate([a.digit_sizes[ids_a], b.digit_sizes[ids_b]])[order]
    begin = np.concatenate([a.digit_begin[ids_a], len(a.digits) + b.digit_begin[ids_b]])[order]
    text = _gather(np.concatenate([a.digits, b.digits]), begin, size)
    last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
    mark = np.concatenate([np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))])[order].astype(np.uint8)
    text[np.cumsum(size) - 1] = mark
    written = np.append(0, np.cumsum(np.bincount(np.concatenate([home_a, home_b])[order], size, n))).astype(np.int64)
    return {
        "bad": bad,
        "n_a": np.bincount(home_a, minlength=n),
        "n_b": np.bincount(home_b, minlength=n),
        "n_groups": np.bincount(np.searchsorted(stops, common), minlength=n),
        "n_links": np.bincount(home, minlength=n),
        "text": text.tobytes(),
        "written": written,
        "pairs": (link_a << 32) | link_b,
    }


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, one compressed frame: narrowest width and length of each array, then all of them."""
    parts, heads = [], []
    for x in arrays:
        top = int(x.max(initial=0))
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
        parts.append(x.astype(kind).tobytes())
        heads += [np.dtype(kind).itemsize, len(x)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array(heads, np.int64).tobytes(), *parts]))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    heads, at, out = np.frombuffer(data, np.int64, 2 * n), 16 * n, []
    for width, length in heads.reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, f"u{width}", length, at).astype(np.int64))
        at += width * length
    return out


def _steps_of(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        offsets, _ = raw(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - size, "right")) - 1)
            more = int(offsets[min(stop, batch.num_rows)] - offsets[at])
            if held and size + more > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(at, stop - at))
            size += more
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def _records(table: pa.Table, a: Side, b: Side, block: int, radices: int, digest: bool) -> Iterator[dict]:
    """Rows of one block: its documents, and per radix of the A id the run of (pair, document, times) records.

    A run is sorted by A id, then B id. Its head has the pairs and in how many documents of
    the block each is linked, in chunks; its body has those documents and how often.
    """
    offsets, data = raw(table.column("text"))
    lengths = np.diff(offsets)
    n_docs = len(lengths)
    filled = np.flatnonzero(lengths)
    data = np.insert(data, offsets[:-1][filled], 32)
    begins = offsets[:-1][filled] + np.arange(len(filled))
    starts = _segments(data, begins, a.splits and b.splits)
    bounds = np.append(starts, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = align_segments(a, b, coded.dictionary.to_pylist())
    owner = filled[np.searchsorted(begins, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    lost = np.zeros(n_docs, bool)
    lost[owner[found["bad"][which]]] = True
    ok = ~lost[owner]
    which, owner = which[ok], owner[ok]
    counts = {k: np.bincount(owner, found[k][which], n_docs).astype(np.int64) for k in _COUNTS}
    edges = np.searchsorted(owner, np.arange(n_docs + 1))
    texts = [found["text"][s:e] for s, e in zip(found["written"][:-1].tolist(), found["written"][1:].tolist(), strict=True)]
    names = table.column("doc_id").to_pylist()
    for i in range(n_docs):
        mine = which[edges[i] : edges[i + 1]]
        hashed, pieces = hashlib.sha256(), []
        for at in range(0, len(mine), 1 << 16):
            piece = b"".join([texts[k] for k in mine[at : at + (1 << 16)].tolist()])
            piece = piece[:-1] if at + (1 << 16) >= len(mine) else piece
            hashed.update(piece) if digest else pieces.append(piece)
        groups = (hashed.hexdigest() if len(mine) else "") if digest else b"".join(pieces).decode()
        yield {"kind": _DOC, "radix": radices, "seq": i, "doc_id": names[i], "groups": groups, **{k: int(v[i]) for k, v in counts.items()}}
    # Records: each segment of a document carries its links as often as it occurs there.
    held, times = np.unique(owner * max(1, len(texts)) + which, return_counts=True)
    doc, seg = held // max(1, len(texts)), held % max(1, len(texts))
    pairs, number = np.unique(found["pairs"], return_inverse=True)
    begin = np.append(0, np.cumsum(found["n_links"]))
    many = found["n_links"][seg]
    record = _gather(number, begin[:-1][seg], many) * n_docs + np.repeat(doc, many)
    weight = np.repeat(times, many)
    order = np.argsort(record, kind="stable")
    record, weight = record[order], weight[order]
    head = np.flatnonzero(np.append(True, record[1:] != record[:-1])[: len(record)])
    weight = np.add.reduceat(weight, head) if len(head) else weight
    record = record[head]
    pair_of, doc = record // n_docs, record % n_docs
    in_docs = np.bincount(pair_of, minlength=len(pairs))
    radix = ((pairs >> 32) * 0x9E3779B1 % (1 << 32) * radices) >> 32
    for r in np.unique(radix[in_docs > 0]).tolist():
        mine = np.flatnonzero((radix == r) & (in_docs > 0))
        keys, n = pairs[mine], in_docs[mine]
        for seq, at in enumerate(range(0, len(mine), CHUNK_PAIRS)):
            part = slice(at, at + CHUNK_PAIRS)
            yield {"kind": _HEAD, "radix": r, "seq": seq, "first": int(keys[at]), "head": _pack(_steps_of(keys[part] >> 32), keys[part] & 0xFFFFFFFF, n[part])}
        take = _gather(np.arange(len(record)), (np.cumsum(in_docs) - in_docs)[mine], n)
        starts = np.append(0, np.cumsum(n))[:-1]
        steps = _steps_of(doc[take])
        steps[starts] = doc[take][starts]  # documents rise inside a pair
        yield {"kind": _BODY, "radix": r, "seq": 0, "body": _pack(n, steps, weight[take])}


_FIELDS = pa.schema(
    [("block", pa.int64()), ("kind", pa.int8()), ("radix", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()),
     ("head", pa.binary()), ("body", pa.binary()), ("doc_id", pa.int64()), *[(k, pa.int64()) for k in _COUNTS], ("groups", pa.string())]
)
_SCHEMA = "block long, kind byte, radix int, seq int, first long, head binary, body binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"


def _settled(open_runs: list, heap: list, bound: int) -> Iterator[tuple]:
    """Count all entries below ``bound`` (an A id's first pair) of the open chunks; gives the chunks that are done."""
    parts = []
    while heap and heap[0][0] < bound:
        _, i = heapq.heappop(heap)
        keys, at = open_runs[i][3], open_runs[i][5]
        stop = int(np.searchsorted(keys, bound))
        parts.append((i, at, stop))
        open_runs[i][5] = stop
        if stop < len(keys):
            heapq.heappush(heap, (int(keys[stop]), i))
    if not parts:
        return
    pairs, number = np.unique(np.concatenate([open_runs[i][3][s:e] for i, s, e in parts]), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, number, np.concatenate([open_runs[i][4][s:e] for i, s, e in parts]))
    # Pairs come by A id, so its highest count is known when its last pair is.
    side_a = pairs >> 32
    begin = np.flatnonzero(np.append(True, side_a[1:] != side_a[:-1]))
    top = np.repeat(np.maximum.reduceat(total, begin), np.diff(np.append(begin, len(pairs))))
    best = (total == top).astype(np.int64)
    at = 0
    for i, s, e in parts:
        mine = number[at : at + e - s]
        at += e - s
        run = open_runs[i]
        run[6].append((total[mine], best[mine]))
        if e == len(run[3]):
            yield run[0], run[1], run[2], _pack(*(np.concatenate(x) for x in zip(*run[6], strict=True)))
            open_runs[i] = None


def count_runs(heads: DataFrame, radices: int) -> DataFrame:
    """(block, radix, seq, back): for each chunk of a run, each pair's count over all blocks and whether it is its A id's highest.

    Spark sorts the chunks of all runs of a radix by their first pair, spilling as it
    needs; the task merges them with a heap. Counts were added up per block before the
    shuffle, so a pair or id that every document holds is one entry per block.
    """

    def run(batches):
        open_runs, heap, radix, entries = [], [], None, 0

        def rows(found):
            cols = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "radix", "seq", "back"])

        for batch in batches:
            for block, r, seq, first, head in zip(*[batch.column(c).to_pylist() for c in ("block", "radix", "seq", "first", "head")], strict=True):
                if radix is not None and (r != radix or entries > OPEN_ENTRIES):
                    yield rows(list(_settled(open_runs, heap, 1 << 62 if r != radix else first >> 32 << 32)))
                    open_runs = [x for x in open_runs if x is not None]
                    heap = [(int(x[3][x[5]]), i) for i, x in enumerate(open_runs)]
                    heapq.heapify(heap)
                    entries = sum(len(x[3]) for x in open_runs)
                radix = r
                a, b, n = _unpack(head, 3)
                heapq.heappush(heap, (first, len(open_runs)))
                open_runs.append([block, r, seq, np.cumsum(a) << 32 | b, n, 0, []])
                entries += len(n)
        yield rows(list(_settled(open_runs, heap, 1 << 62)))

    dealt = heads.repartition(radices, "radix").sortWithinPartitions("radix", "first")
    return dealt.mapInArrow(run, "block long, radix int, seq int, back binary")


def _sums(rows: DataFrame) -> DataFrame:
    """Per document (doc_id, counts, n_best, count_sum, groups) from bodies, backs and documents of blocks."""

    def run(batches):
        block, n_best, count_sum, backs = None, np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out = []
            for i in range(batch.num_rows):
                if cols["block"][i] != block:
                    block, n_best, count_sum, backs = cols["block"][i], np.zeros(0, np.int64), np.zeros(0, np.int64), []
                kind = cols["kind"][i]
                if kind == _HEAD:
                    backs.append(_unpack(cols["back"][i], 2))
                elif kind == _BODY:
                    total, best = (np.concatenate(x) for x in zip(*backs, strict=True))
                    n, steps, times = _unpack(cols["body"][i], 3)
                    backs = []
                    far = np.cumsum(steps)
                    begin = np.append(0, np.cumsum(n))[:-1]
                    doc = far - np.repeat(far[begin] - steps[begin], n)
                    size = max(len(n_best), int(doc.max()) + 1)
                    n_best, count_sum = (np.append(x, np.zeros(size - len(x), np.int64)) for x in (n_best, count_sum))
                    np.add.at(n_best, doc, times * np.repeat(best, n))
                    np.add.at(count_sum, doc, times * np.repeat(total, n))
                else:
                    at = cols["seq"][i]
                    known = at < len(n_best)
                    out.append((cols["doc_id"][i], *[cols[k][i] for k in _COUNTS], int(n_best[at]) if known else 0, int(count_sum[at]) if known else 0, cols["groups"][i]))
            found = list(zip(*out, strict=True)) or [[]] * 8
            names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups"]
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def align(docs: DataFrame, a: str = f"{FOLDER}/{SIDE_A}", b: str = f"{FOLDER}/{SIDE_B}", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row of ``docs``.

    A blank and the text are encoded by the tokenizers of files ``a`` and ``b``; byte
    offsets where tokens of both end cut them into groups. A link is a pair of tokens of
    the two sides with overlapping bytes. An id pair's count is the number of rows that
    hold it linked; n_best counts the links whose count is the highest of their A id, ties
    included, count_sum adds the counts of all links. ``groups`` is "a1,a2|b1;a3|b2" in
    ids; with ``digest`` its SHA-256 in hex. Null and empty texts, and texts that the tokens
    of a side do not spell, have zeros and empty ``groups``. Repeated rows count each,
    extra columns are not read, an empty table gives no rows.

    Tasks turn blocks of text into runs of (id pair, document) records, one compressed run
    per radix of the A id; heads of runs are merged and counted radix by radix, and the
    counts go back to the block, where each run's body spreads them over documents. Texts
    are cut where no token of either side can cross, and equal pieces of a block are encoded once.
    """
    session = docs.sparkSession
    bound_batches(docs)
    radices = int(session.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        left, right = side(a), side(b)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        for i, table in enumerate(_blocks(batches, BLOCK_BYTES)):
            held, size = [], 0
            for row in _records(table, left, right, base + i, radices, digest):
                held.append(row | {"block": base + i})
                size += len(row.get("body") or b"") + len(row.get("groups") or "") + 200
                if size > 2 << 20:
                    yield pa.RecordBatch.from_pylist(held, _FIELDS)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, _FIELDS)
        pa.default_memory_pool().release_unused()

    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, _SCHEMA))
    heads = rows.where(F.col("kind") == _HEAD).select("block", "radix", "seq", "first", "head")
    backs = cut(count_runs(heads, radices)).select("block", F.lit(_HEAD).cast("byte").alias("kind"), "radix", "seq", "back")
    rest = rows.where(F.col("kind") != _HEAD).drop("first", "head")
    both = rest.unionByName(backs, allowMissingColumns=True)
    return _sums(both.repartition("block").sortWithinPartitions("block", "radix", "kind", "seq"))

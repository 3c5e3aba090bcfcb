"""Secret scans through nested encodings."""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import map_texts

# The patterns of the three kinds and their least lengths, in the order of the kinds.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# Encoded stretches: with a URL escape, with a Unicode escape, or of sixteen base64 digits.
_URL = re.compile(r"(?:[A-Za-z0-9_.~+=&:/?-]|%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:[\x21-\x5B\x5D-\x7E]|\\u[0-9A-Fa-f]{4})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+")
# Base64 broken into lines, as in mail.
_LINES = re.compile(r"(?:[A-Za-z0-9+/]{16,}\r?\n[\x20\t]*)+[A-Za-z0-9+/]{2,}={0,2}")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})")
_BREAK = re.compile(r"[/_+-]+")
_WORDLIKE = re.compile(r"[a-z]*|[A-Z][a-z]*|[A-Z]*|[0-9]*")

# The least secret has twelve characters, so shorter stretches between unreadable bytes hold none.
_GZIP = re.compile(rb"\x1f\x8b\x08")
_STRETCH = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]{12,}")

#: A compressed layer is scanned in pieces of this many bytes, each with the end of the one before.
PIECE_BYTES, CARRY_BYTES = 8 << 20, 64 << 10
#: Compressed bytes are fed in steps of this size.
FEED_BYTES = 16 << 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost and non-overlapping per kind, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def _packed(head: bytes) -> bool:
    """Whether these bytes may begin a gzip, zlib, bzip2 or xz stream."""
    if head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00":
        return True
    return len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0


class _Inflater:
    """zlib's stream under the names that bz2 and lzma give theirs."""

    def __init__(self, bits: int):
        self._stream = zlib.decompressobj(bits)

    def decompress(self, fed: bytes, most: int) -> bytes:
        return self._stream.decompress(self._stream.unconsumed_tail + fed, most)

    eof = property(lambda self: self._stream.eof)
    unused_data = property(lambda self: self._stream.unused_data)
    needs_input = property(lambda self: not self._stream.unconsumed_tail)


def _stream_of(head: bytes):
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:2] == b"\xfd7":
        return lzma.LZMADecompressor()
    return _Inflater(31 if head[:2] == b"\x1f\x8b" else 15)


def _members(data: bytes) -> Iterator[bytes]:
    """Pieces of what the streams at the start of ``data``, one after another, hold; up to the first fault."""
    at = 0
    while _packed(data[at : at + 6]):
        stream = _stream_of(data[at : at + 6])
        try:
            while not stream.eof:
                fed = data[at : at + FEED_BYTES] if stream.needs_input else b""
                at += len(fed)
                waited = stream.needs_input
                piece = stream.decompress(fed, PIECE_BYTES)
                if piece:
                    yield piece
                elif waited and not fed:
                    return
        except (zlib.error, lzma.LZMAError, OSError):
            return
        at -= len(stream.unused_data)


def _overlapped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces of one layer in larger ones, each with the end of the one before."""
    carry, held, size = b"", [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= PIECE_BYTES:
            whole = carry + b"".join(held)
            carry, held, size = whole[-CARRY_BYTES:], [], 0
            yield whole
            del whole
    if held:
        whole = carry + b"".join(held)
        del carry, held, pieces
        yield whole


def _inner(data: bytes) -> Iterator[bytes]:
    """What the streams of ``data`` hold, in pieces that overlap; nothing if it only looks like a stream."""
    return _overlapped(_members(data))


def _unfolded(data: bytes) -> Iterator[bytes]:
    """Pieces of what compressed streams hold, streams inside streams opened to any depth; other bytes as they are.

    Open streams wait on a list, with their marks, so one that unfolds to itself ends.
    """
    work: list[tuple[Iterator[bytes], bytes | None]] = [(iter([data]), None)]
    around: set[bytes] = set()
    del data
    while work:
        data = next(work[-1][0], None)
        if data is None:
            around.discard(work.pop()[1])
            continue
        mark = hashlib.blake2b(data, digest_size=16).digest()
        if mark in around or not _packed(data[:6]):
            yield data
            continue
        pieces = _inner(data)
        first = next(pieces, None)
        if first is None:
            yield data
            continue
        around.add(mark)
        work.append((itertools.chain([first], pieces), mark))
        del first, pieces


def _raw_members(data: bytes) -> Iterator[bytes]:
    """Pieces of what a deflate stream without a head holds; an error unless it ends where ``data`` does."""
    stream, at = _Inflater(-15), 0
    while not stream.eof:
        waited = stream.needs_input
        fed = data[at : at + FEED_BYTES] if waited else b""
        at += len(fed)
        piece = stream.decompress(fed, PIECE_BYTES)
        if piece:
            yield piece
        elif waited and not fed:
            raise zlib.error("the stream ends early")
    if stream.unused_data or at < len(data):
        raise zlib.error("more follows the stream")


def _raw_deflate(data: bytes) -> Iterator[bytes]:
    """All of a deflate stream without a head, in pieces that overlap, if ``data`` is one from start to end; else nothing.

    Any bytes may begin such a stream, so it is run to its end first.
    """
    try:
        for _ in _raw_members(data):
            pass
    except zlib.error:
        return
    yield from _overlapped(_raw_members(data))


def _readable(data: bytes) -> list[str]:
    """The text if most of it is readable, else its readable stretches."""
    text = data.decode("utf-8", "replace")
    # a piece may start and end inside a character
    if text.count("�") <= 2 and sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.9 * len(text):
        return [text] if text else []
    return _STRETCH.findall(text)


def _opened(data: bytes) -> Iterator[str]:
    for piece in _unfolded(data):
        yield from _readable(piece)


def _base64_layers(run: str) -> Iterator[str]:
    """What a run of base64 digits holds from each of its four alignments on.

    Other words may stand before or after the encoded ones, so streams are also opened
    after each break in the run, and gzip streams wherever they begin.
    """
    token = run.rstrip("=").replace("-", "+").replace("_", "/")
    if _WORDLIKE.fullmatch(token):
        return
    breaks = [m.end() for m in _BREAK.finditer(token)]
    breaks += [m.start() + 1 for m in _BREAK.finditer(token) if m.end() - m.start() > 1]
    for shift in range(4):
        part = token[shift : len(token) - ((len(token) - shift) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        yield from _opened(data)
        if shift == 0 and not _packed(data[:6]):
            for piece in _raw_deflate(data):
                yield from _readable(piece)
        starts = {(p - shift) // 4 * 3 for p in breaks if p > shift and p % 4 == shift}
        starts.update(m.start() for m in _GZIP.finditer(data, 1))
        for p in sorted(starts):
            if _packed(data[p : p + 6]):
                for piece in _unfolded(data[p:]):
                    if piece != data[p:]:
                        yield from _readable(piece)


def layers_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) for each stretch of ``text`` that one of the decoders opens."""
    out = []
    if "%" in text:
        for m in _URL.finditer(text):
            if "%" in m[0]:
                out += [(m.start(), m.end(), plain) for plain in _opened(unquote_to_bytes(m[0]))]
    if "\\u" in text:
        for m in _UNICODE.finditer(text):
            if "\\u" not in m[0]:
                continue
            plain = _ESCAPE.sub(lambda x: chr(int(x[1], 16)), m[0]).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            out.append((m.start(), m.end(), plain))
            if max(plain) <= "\xff" and _packed(data := plain.encode("latin-1")):
                out += [(m.start(), m.end(), inner) for inner in _opened(data)]
    for m in _BASE64.finditer(text):
        out += [(m.start(), m.end(), plain) for plain in _base64_layers(m[0])]
    if "\n" in text:
        for m in _LINES.finditer(text):
            out += [(m.start(), m.end(), plain) for plain in _base64_layers(re.sub(r"\s+", "", m[0]))]
    return out


class View:
    """A text with escapes decoded in place, and the stretch of the original behind each stretch of it."""

    def __init__(self, text: str, marks: list[tuple[int, int, int]], under: View | None = None):
        self.text, self.under = text, under
        self.begin, self.source, self.width = ([m[i] for m in marks] for i in range(3))

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        """(start, end, decoded): the original stretch, and whether an escape is in it."""
        i, j = bisect.bisect_right(self.begin, start) - 1, bisect.bisect_right(self.begin, end - 1) - 1
        first = self.source[i] + (0 if self.width[i] else start - self.begin[i])
        last = self.source[j] + (self.width[j] or end - self.begin[j])
        hit = any(self.width[k] for k in range(i, j + 1))
        if self.under is None:
            return first, last, hit
        first, last, below = self.under.span(first, last)
        return first, last, hit or below


def _unescaped(m: re.Match) -> str:
    """Characters of a row of URL or Unicode escapes."""
    if m[0][0] == "%":
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")
    return bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be", "replace")


def in_place(text: str, under: View | None = None) -> View | None:
    """``text`` with every URL and Unicode escape decoded where it stands; None if it has none."""
    out, marks, at, size = [], [], 0, 0
    for m in _ESCAPES.finditer(text) if "%" in text or "\\u" in text else ():
        plain = _unescaped(m)
        if m.start() > at:
            marks.append((size, at, 0))
            out.append(text[at : m.start()])
            size += m.start() - at
        step = 3 if m[0][0] == "%" else 6
        if len(plain) * step == len(m[0]):  # each character is one escape
            marks += [(size + k, m.start() + k * step, step) for k in range(len(plain))]
        elif plain:
            marks.append((size, m.start(), len(m[0])))
        out.append(plain)
        size += len(plain)
        at = m.end()
    if not at:
        return None
    if at < len(text):
        marks.append((size, at, 0))
        out.append(text[at:])
    return View("".join(out), marks, under) if marks else None


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """Base spans, all spans, and the number of decoded layers of one text.

    A worklist holds decoded layers with the span of the original text they came from.
    Each layer is scanned and opened again until nothing new appears; a layer already
    seen at the same span is dropped, which ends cycles. A secret found in a layer is
    reported at the outermost encoded stretch of the original text. Escapes are also
    decoded in place, again and again, so a secret of which only parts are escaped is
    found, at the stretch of the original that it comes from.
    """
    base = base_spans(text)
    found, seen, layers = set(base), set(), 0
    work = layers_of(text)
    view = in_place(text)
    while view is not None:
        layers += 1
        for s, e, kind in base_spans(view.text):
            start, end, decoded = view.span(s, e)
            if decoded:
                found.add((start, end, kind))
        for s, e, plain in layers_of(view.text):
            start, end, decoded = view.span(s, e)
            if decoded:
                work.append((start, end, plain))
        view = in_place(view.text, view)
    while work:
        start, end, plain = work.pop()
        mark = (start, end, hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        found.update((start, end, kind) for _, _, kind in base_spans(plain))
        work += [(start, end, inner) for _, _, inner in layers_of(plain) if inner != plain]
        whole = in_place(plain)
        if whole is not None:
            work.append((start, end, whole.text))
    rank = KINDS.index
    return base, sorted(found, key=lambda x: (x[0], rank(x[2]), x[1])), layers


def _joined(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers) per row.

    The counts are of base spans; ``spans`` adds those of decoded layers. Whole texts are
    read; null is the empty text with no spans. Repeated rows get equal answers, extra
    columns are not read, an empty table gives no rows.
    """

    def run(batch):
        rows = [scan(t) if t else ([], [], 0) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(k == kind for _, _, k in base) for base, _, _ in rows], pa.int64()) for kind in KINDS]
        digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(digests), pa.array([_joined(a) for _, a, _ in rows]), pa.array([n for _, _, n in rows], pa.int64())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"
    return map_texts(docs.select("doc_id", "text"), run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the scan, overlapping ones merged, replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if not t else _cut_out(t, scan(t)[1], mark))

    return docs.withColumn("text", clean("text"))


def _cut_out(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])

"""External induced sorting of suffixes with their common prefixes, in bounded memory.

Numpy only; Spark decides which strings meet in one call (see ``suffixes``). Symbols are
visited bucket by bucket in order. Each suffix that is placed queues the suffix one symbol
longer, together with the common prefix it keeps with the one queued before it under the
same symbol. The queue is a radix priority queue: its priority is the bucket, tuples of one
bucket come out as they went in, and what exceeds its memory lies in a temporary file
that only this process knows. Sorting the substrings between valleys (LMS) uses the same
induction, and their names are sorted by recursion.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of tuples a queue keeps in memory, and size from which an array lies in a file.
QUEUE_BYTES, ARRAY_BYTES = 64 << 20, 256 << 20
#: Common prefixes are exact up to this length.
CAP = 255

_rng = np.random.default_rng(11)
_BASES = _rng.integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_SYMBOLS = _rng.integers(0, 1 << 63, 1 << 9, dtype=np.uint64)


def array(n: int, kind) -> np.ndarray:
    """An array in memory or, if large, in an unnamed temporary file."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= ARRAY_BYTES:
        return np.empty(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=n)


class DiskQueue:
    """Tuples (position, common prefix) by bucket; buckets are taken in ascending order."""

    def __init__(self, buckets: int, limit: int = QUEUE_BYTES):
        self.held: list[list] = [[] for _ in range(buckets)]
        self.runs: list[list] = [[] for _ in range(buckets)]
        self.bytes, self.limit, self.file = 0, limit, None

    def push(self, bucket: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples sorted by bucket."""
        if not len(pos):
            return
        rows = pos << 8 | lcp
        edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
            self.held[bucket[start]].append(rows[start:end])
        self.bytes += rows.nbytes
        if self.bytes > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for k, parts in enumerate(self.held):
            if parts:
                rows = np.concatenate(parts)
                self.runs[k].append((self.file.tell(), len(rows)))
                rows.tofile(self.file)
                self.file.seek(0, 2)
                self.held[k] = []
        self.bytes = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for at, n in self.runs[bucket]:
            self.file.seek(at)
            parts.append(np.fromfile(self.file, np.int64, n))
        parts += self.held[bucket]
        self.bytes -= sum(p.nbytes for p in self.held[bucket])
        self.held[bucket] = []
        rows = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return rows >> 8, (rows & 255).astype(np.int16)


class _Minima:
    """Minimum over ranges of one block."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[start:end], ranges not empty."""
        k = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for level in np.unique(k):
            i = k == level
            v = self.levels[level]
            out[i] = np.minimum(v[start[i]], v[end[i] - (1 << level)])
        return out


def _buckets(t: np.ndarray, wanted: np.ndarray, size: int) -> np.ndarray:
    """First symbol of each bucket: as many symbols as do not induce one another, alone if it induces itself."""
    i = np.flatnonzero(wanted[:-1])
    low = np.full(size + 1, size, np.int64)
    np.minimum.at(low, t[i + 1], t[i])
    low = np.minimum.accumulate(low[::-1])[::-1]
    first, at = [], 0
    while at < size:
        first.append(at)
        at = max(int(low[at]), at + 1)
    return np.array(first)


def _induce(t, wanted, size, seeds, seed_lcp, start, runs, queue_bytes):
    """Suffixes in ascending order of ``t``: ``wanted`` ones induced, each symbol's ``seeds`` after them.

    ``seeds`` are sorted. Returns positions and, if ``seed_lcp`` is given, common prefixes
    with the position before. ``start`` is induced by the end of the text.
    """
    carry = seed_lcp is not None
    first = _buckets(t, wanted, size)
    ends = np.append(first[1:], size)
    bucket_of = np.repeat(np.arange(len(first)), ends - first)
    queue = DiskQueue(len(first), queue_bytes)
    total = int(np.count_nonzero(wanted)) + len(seeds)
    out, out_lcp = array(total, np.int64), array(total if carry else 0, np.int16)
    since = np.full(size, -1, np.int16)
    filled = 0

    def place(pos, lcp, loop):
        """Add a block and queue what it induces; gives the tuples it induces under symbol ``loop``."""
        nonlocal filled
        out[filled : filled + len(pos)] = pos
        if carry:
            out_lcp[filled : filled + len(pos)] = lcp
        filled += len(pos)
        j = np.flatnonzero(pos > 0)
        j = j[wanted[pos[j] - 1]]
        symbol = t[pos[j] - 1]
        order = np.argsort(symbol, kind="stable")
        j, symbol = j[order], symbol[order]
        new = np.zeros(len(j), np.int16)
        if len(j):
            fresh = np.append(True, symbol[1:] != symbol[:-1])
            if carry:
                before = np.where(fresh, 0, np.append(0, j[:-1] + 1))
                least = _Minima(lcp).over(before, j + 1)
                least[fresh] = np.minimum(least[fresh], since[symbol[fresh]])
                new = np.minimum(least + 1, CAP).astype(np.int16)
        if carry and len(pos):
            np.minimum(since, lcp.min(), out=since)
            if len(j):
                last = np.append(fresh[1:], True)
                rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], CAP)
                since[symbol[last]] = rest[j[last]]
        stay = symbol == loop
        if stay.any():
            pushed, p = ~stay, pos[j] - 1
            queue.push(bucket_of[symbol[pushed]], p[pushed], new[pushed])
            return p[stay], new[stay]
        queue.push(bucket_of[symbol], pos[j] - 1, new)
        return None

    if start is not None:
        queue.push(bucket_of[t[start : start + 1]], np.array([start]), np.zeros(1, np.int16))
        since[t[start]] = 0  # the end of the text shares nothing with what follows
    seed_symbol = t[seeds]
    edges = np.searchsorted(seed_symbol, np.append(first, size))
    for k, (lo, hi) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        pos, lcp = queue.pop(k)
        seed = seeds[edges[k] : edges[k + 1]]
        lcp_s = seed_lcp[edges[k] : edges[k + 1]].copy() if carry else np.zeros(len(seed), np.int16)
        if hi - lo == 1:
            tail = None
            while len(pos):
                tail = pos[-1]
                again = place(pos, lcp, lo)
                pos, lcp = again if again else (pos[:0], lcp[:0])
            if len(seed):
                if carry:
                    lcp_s[0] = 0 if tail is None else min(runs[tail], runs[seed[0]], CAP)
                place(seed, lcp_s, -1)
            continue
        both, kind = np.concatenate([pos, seed]), np.repeat([0, 1], [len(pos), len(seed)])
        order = np.argsort(t[both], kind="stable")
        symbol, pos, kind = t[both][order], both[order], kind[order]
        lcp = np.concatenate([lcp, lcp_s])[order]
        if carry and len(pos):
            fresh = np.append(True, symbol[1:] != symbol[:-1])
            lcp[fresh] = 0
            seam = np.flatnonzero(~fresh & (np.append(0, kind[:-1]) == 0) & (kind == 1))
            lcp[seam] = np.minimum(np.minimum(runs[pos[seam - 1]], runs[pos[seam]]), CAP)
        if len(pos):
            place(pos, lcp, -1)
    return out, out_lcp


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending, run): whether the suffix is smaller than the next one, and how often its symbol repeats."""
    n = len(t)
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # last place of each run
    sizes = np.diff(np.append(-1, change))
    rises = np.zeros(len(change), bool)
    rises[:-1] = t[change[:-1] + 1] > t[change[:-1]]
    left = np.repeat(change, sizes) - np.arange(n) + 1
    return np.repeat(rises, sizes), np.minimum(left, CAP).astype(np.int16)


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` symbols at ``a`` and at ``b`` are the same."""
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    for d in range(int(length.max(initial=0))):
        live = live[length[live] > d]
        differ = t[a[live] + d] != t[b[live] + d]
        same[live[differ]] = False
        live = live[~differ]
        if not len(live):
            break
    return same


def _prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes up to CAP of neighbours in ``order``, by hashes of 64, 8 and 1 symbols."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp.astype(np.int16)
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(CAP + 1, np.int64)])
    word = _SYMBOLS[padded]
    words = {1: word}
    for k in range(6):
        half = 1 << k
        word = word[:-half] * _BASES[k] + word[half:]
        if 2 * half in (8, 64):
            words[2 * half] = word
    a, b = order[:-1], order[1:]
    for step, most in ((64, 3), (8, 7), (1, 7)):
        w, live = words[step], np.arange(len(a))
        for _ in range(most):
            at = lcp[1:][live]
            x, y = a[live] + at, b[live] + at
            ok = (np.maximum(x, y) < len(t)) & (w[np.minimum(x, len(w) - 1)] == w[np.minimum(y, len(w) - 1)])
            live = live[ok]
            lcp[1:][live] += step
    return np.minimum(lcp, CAP).astype(np.int16)


def suffix_order(t: np.ndarray, prefixes: bool = True, queue_bytes: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray | None]:
    """Positions of all suffixes of ``t`` in order, and common prefixes with the one before, up to CAP.

    ``t`` holds small non-negative integers; a suffix that is a prefix of another comes
    first. With ``prefixes`` symbols are below 511.
    """
    n = len(t)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int16) if prefixes else None
    t = np.asarray(t)
    size = int(t.max()) + 1
    rising, runs = _types(t)
    falling = ~rising
    valley = np.flatnonzero(rising[1:] & falling[:-1]) + 1
    flipped = (size - 1 - t).astype(t.dtype)

    def both(seeds, seed_lcp):
        down, down_lcp = _induce(t, falling, size, seeds, seed_lcp, n - 1, runs, queue_bytes)
        keep = falling[down]
        tops = down[keep]
        if seed_lcp is None:
            up, _ = _induce(flipped, rising, size, tops[::-1], None, None, runs, queue_bytes)
            return up[::-1], None
        # Falling suffixes stand before the seeds of their symbol, so neighbours stay neighbours
        # except across symbols, where nothing is common.
        lcp = down_lcp[keep]
        lcp[np.append(True, t[tops[1:]] != t[tops[:-1]])] = 0
        up, up_lcp = _induce(flipped, rising, size, tops[::-1], np.append(np.int16(0), lcp[:0:-1]), None, runs, queue_bytes)
        return up[::-1], np.append(np.int16(0), up_lcp[:0:-1])

    seeds = valley[np.argsort(t[valley], kind="stable")]
    if len(valley) > 1:
        place = np.zeros(n, bool)
        place[valley] = True
        rough, _ = both(seeds, None)
        rough = rough[place[rough]]
        length = np.zeros(n, np.int64)
        length[valley] = np.diff(np.append(valley, n - 1)) + 1
        a, b = rough[:-1], rough[1:]
        last = valley[-1]  # ends with the text, so it equals no other
        same = (length[a] == length[b]) & (a != last) & (b != last)
        i = np.flatnonzero(same)
        same[i] = _same(t, a[i], b[i], length[a[i]])
        name = np.append(0, np.cumsum(~same))
        if name[-1] + 1 == len(valley):
            seeds = rough
        else:
            named = np.zeros(n, np.int64)
            named[rough] = name
            seeds = valley[suffix_order(named[valley], False, queue_bytes)[0]]
    return both(seeds, _prefixes(t, seeds) if prefixes else None)

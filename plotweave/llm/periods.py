"""Periodic runs of words by grammar compression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plotweave.llm.common import map_texts, raw

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods below this are tried one by one, longer ones where this many words recur.
GRAM = 8
#: A text is compressed in parts of so many words, whose roots are then joined.
PART_WORDS = 1 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of each pair of numbers."""
    x = a.astype(np.uint64) * _MIX[0] + b.astype(np.uint64)
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(32))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, ends, first, bytes): words between ASCII white space, equal ones with equal ids.

    ``first`` has the number of words before each row and their total.
    """
    offsets, data = raw(texts)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~space
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, space[:-1])[: len(data)]))
    ends = np.flatnonzero(inside & (edge[1:] | np.append(space[1:], True)[: len(data)])) + 1
    packed = np.ascontiguousarray(data[inside])
    bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    ids = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, starts, ends, np.searchsorted(starts, offsets), data


def re_pair(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of the sequences that ``owner`` tells apart: (rule, at, mid, end, top).

    One entry per occurrence of a rule: its first word, where its right half begins, the
    word after it; equal ``rule`` means equal words. ``top`` holds the places where symbols
    of the final sequences begin. In a round the most frequent pairs of neighbours are
    replaced wherever they stand, also less frequent ones that no more frequent pair
    touches; pairs of equal frequency are ranked by a hash, so long copies shrink
    everywhere at once. Pairs seen once can never recur and are not counted again.
    """
    n = len(ids)
    symbol = ids.copy()
    after = np.arange(1, n + 1)  # where the next symbol begins
    before = np.arange(-1, n - 1)
    last = np.append(owner[1:] != owner[:-1], True)[:n]  # the symbol that begins here has no right neighbour
    active = np.flatnonzero(~last)
    fresh = int(ids.max(initial=-1)) + 1
    rank = np.zeros(n + 1, np.int64)
    rules, ats, mids, ends = [], [], [], []
    while len(active):
        right = after[active]
        key = _mixed(_mixed(symbol[active], symbol[right]), owner[active])
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        group = np.empty(len(active), np.int64)
        group[order] = np.cumsum(new) - 1
        # Of overlapping pairs of one symbol every second counts.
        twin = symbol[active] == symbol[right]
        odd = np.zeros(len(active), bool)
        if twin.any():
            chained = np.append(False, twin[1:] & twin[:-1] & (active[1:] == right[:-1]) & (group[1:] == group[:-1]))
            place = np.arange(len(active))
            begin = np.maximum.accumulate(np.where(chained, 0, place))
            odd = (place - begin) % 2 == 1
        count = np.bincount(group[~odd], minlength=int(group.max()) + 1)
        # Rank by count, then hash of the pair.
        better = np.lexsort((ordered[new], count))
        place = np.empty(len(count), np.int64)
        place[better] = np.arange(1, len(count) + 1)
        mine = place[group]
        rank[active] = np.where(odd, 0, mine)
        left = before[active]
        rival = np.maximum(np.where(left >= 0, rank[left], 0), np.where(last[right], 0, rank[right % n]))
        chosen = ~odd & (count[group] >= 2) & (mine > rival)
        used = np.bincount(group[chosen], minlength=len(count))
        chosen &= used[group] >= 2
        rank[active] = 0
        if not chosen.any():
            break
        at, mid = active[chosen], right[chosen]
        end = after[mid]
        number = np.cumsum(used >= 2) - 1 + fresh
        fresh = int(number[-1]) + 1
        symbol[at] = number[group[chosen]]
        after[at] = end
        last[at] = last[mid]
        inner = end[end < n]
        before[inner] = at[end < n]
        rules.append(symbol[at])
        ats.append(at)
        mids.append(mid)
        ends.append(end)
        # Pairs to count next: repeated ones that still stand, and those beside new symbols.
        gone = np.zeros(n + 1, bool)
        gone[mid] = True
        beside = np.zeros(n + 1, bool)
        beside[active[count[group] >= 2]] = True
        beside[at] = True
        beside[before[at][before[at] >= 0]] = True
        beside &= ~gone
        active = np.flatnonzero(beside[:n])
        active = active[~last[active]]
    top = np.ones(n, bool)
    for x in mids:
        top[x] = False
    join = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rules, ats, mids, ends)]
    return *join, np.flatnonzero(top)


def _halves(top: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, mid, end) of balanced joins of the symbols that begin at ``top``, up to one symbol per owner."""
    out = []
    ends = np.append(top[1:], n)[: len(top)]
    while len(top):
        mine = owner[top]
        first = np.append(True, mine[1:] != mine[:-1])
        place = np.arange(len(top))
        place -= np.maximum.accumulate(np.where(first, place, 0))
        second = place % 2 == 1
        if not second.any():
            break
        i = np.flatnonzero(second)
        out.append((top[i - 1], top[i], ends[i]))
        ends[i - 1] = ends[i]
        top, ends = top[~second], ends[~second]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _reach(ids: np.ndarray, i: int, q: int, stop: int, step: int) -> int:
    """First place from ``i`` on, in direction ``step``, whose word differs from the one ``q`` further; ``stop`` if none."""
    size = 64
    while i != stop:
        lo, hi = (i, min(stop, i + size)) if step > 0 else (max(stop, i - size) + 1, i + 1)
        if step < 0:
            lo = max(stop + 1, i - size + 1)
        bad = np.flatnonzero(ids[lo:hi] != ids[lo + q : hi + q])
        if len(bad):
            return int(lo + bad[0]) if step > 0 else int(lo + bad[-1])
        i = hi if step > 0 else lo - 1
        size *= 4
    return stop


def _crossing(ids: np.ndarray, at: int, mid: int, end: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """(start, period, end) of the runs inside [at, end) with words on both sides of ``mid``; ``periods`` rise."""
    found: list[tuple[int, int, int]] = []
    for q in periods:
        if 4 * q > end - at:
            break
        # A run of four periods holds two of them on one side of the boundary.
        for seed in (mid, mid - q - 1):
            if not (at <= seed and seed + q < end and ids[seed] == ids[seed + q]):
                continue
            if any(q % p == 0 and s <= seed and seed + q < e for s, p, e in found):
                continue  # a multiple of the period of a run that is known
            stop = _reach(ids, seed, q, end - q, 1) + q
            start = _reach(ids, seed, q, at - 1, -1) + 1
            if start < mid < stop and stop - start >= max(LEAST_WORDS, LEAST_PERIODS * q) and (start, q, stop) not in found:
                found.append((start, q, stop))
    return found


def _gram_hash(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on; places without so many are left out."""
    h, width = ids.astype(np.uint64), 1
    while width < GRAM:
        h = _mixed(h[:-width], h[width:])
        width *= 2
    return h


def _periods(ids: np.ndarray, at: np.ndarray, mid: np.ndarray, end: np.ndarray) -> dict[int, list[int]]:
    """Index of each boundary that a run may cross -> its possible periods, rising."""
    out: dict[int, set[int]] = {}
    n, size = len(ids), end - at
    for q in range(1, GRAM):
        wide = np.flatnonzero(size >= max(LEAST_WORDS, LEAST_PERIODS * q))
        m = mid[wide]
        for base in (m, m - 2 * q):  # a square begins at the boundary or ends there
            ok = (base >= at[wide]) & (base + 2 * q <= end[wide])
            for k in range(q):
                if not ok.any():
                    break
                b = np.clip(base + k, 0, n - 1)
                ok &= ids[b] == ids[np.minimum(b + q, n - 1)]
            for i in wide[ok].tolist():
                out.setdefault(i, set()).add(q)
    wide = np.flatnonzero(size >= LEAST_PERIODS * GRAM)
    if len(wide):
        h = _gram_hash(ids)
        order = np.argsort(h, kind="stable")
        slot = np.empty(len(h), np.int64)
        slot[order] = np.arange(len(h))
        for i in wide.tolist():
            far = int(size[i]) // LEAST_PERIODS
            for place, step in ((int(mid[i]), 1), (int(mid[i]) - GRAM, -1)):
                if not (int(at[i]) <= place and place + GRAM <= int(end[i])):
                    continue
                k = int(slot[place]) + step
                while 0 <= k < len(h) and h[order[k]] == h[place] and abs(int(order[k]) - place) <= far:
                    if abs(int(order[k]) - place) >= GRAM:
                        out.setdefault(i, set()).add(abs(int(order[k]) - place))
                    k += step
    return {i: sorted(qs) for i, qs in out.items()}


def _merged(runs: np.ndarray) -> np.ndarray:
    """Rows (start, period, end), each the union of those that share a period's length, sorted by start, then period."""
    if not len(runs):
        return runs.reshape(0, 3)
    runs = runs[np.lexsort((-runs[:, 2], runs[:, 0], runs[:, 1]))]
    out: list[list[int]] = []
    for s, q, e in runs.tolist():
        if out and out[-1][1] == q and out[-1][2] - s >= q:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([s, q, e])
    got = np.array(out, np.int64)
    return got[np.lexsort((got[:, 1], got[:, 0]))]


def grammar_runs(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, top): rows (start, period, end) found at the boundaries of the grammar, and where its final symbols begin.

    Runs inside a rule are found once, at its first occurrence, and moved to all others. A
    run lies inside the smallest node that contains it and crosses its boundary, so every
    maximal run is among the rows, beside parts of it from smaller nodes.
    """
    rule, at, mid, end, top = re_pair(ids, owner)
    a2, m2, e2 = _halves(top.copy(), owner, len(ids))
    rule = np.concatenate([rule, -1 - np.arange(len(a2))])
    at, mid, end = (np.concatenate(x) for x in ((at, a2), (mid, m2), (end, e2)))
    wide = np.flatnonzero(end - at >= LEAST_WORDS)
    if not len(wide):
        return np.zeros((0, 3), np.int64), top
    rule, at, mid, end = rule[wide], at[wide], mid[wide], end[wide]
    order = np.argsort(rule, kind="stable")
    once = np.append(True, rule[order][1:] != rule[order][:-1])
    first, heads = order[once], np.append(np.flatnonzero(once), len(order))
    rows = []
    for k, periods in _periods(ids, at[first], mid[first], end[first]).items():
        i = int(first[k])
        for s, q, e in _crossing(ids, int(at[i]), int(mid[i]), int(end[i]), periods):
            move = at[order[heads[k] : heads[k + 1]]] - at[i]
            rows.append(np.stack([s + move, np.full(len(move), q), e + move], axis=1))
    return (np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)), top


def _joined_runs(ids: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Runs that cross the boundaries of the parts of a text that begin at ``cuts``, joined two by two."""
    bounds, rows = [*cuts, len(ids)], []
    while len(bounds) > 2:
        for at, mid, end in zip(bounds[:-2:2], bounds[1:-1:2], bounds[2::2], strict=True) if len(bounds) % 2 else zip(bounds[:-3:2], bounds[1:-2:2], bounds[2:-1:2], strict=True):
            far = (end - at) // LEAST_PERIODS
            periods = set(range(1, GRAM))
            for place, lo, hi in ((mid, mid + GRAM, min(end - GRAM, mid + far) + 1), (mid - GRAM, max(at, mid - GRAM - far), mid - 2 * GRAM + 1)):
                for begin in range(lo, hi, PART_WORDS):  # places where the same words recur
                    stop = min(hi, begin + PART_WORDS)
                    same = np.ones(stop - begin, bool)
                    for k in range(GRAM):
                        same &= ids[begin + k : stop + k] == ids[place + k]
                    periods.update(np.abs(np.flatnonzero(same) + begin - place).tolist())
            rows += _crossing(ids, at, mid, end, sorted(periods))
        bounds = [*bounds[:-1:2], bounds[-1]] if len(bounds) % 2 == 0 else bounds[::2]
    return np.array(rows, np.int64).reshape(-1, 3)


def runs_of(ids: np.ndarray, first: np.ndarray, part: int = PART_WORDS) -> list[np.ndarray]:
    """Per row, (start, period, end) of its maximal runs, by start, then period; ``first`` as ``words_of`` gives it."""
    lengths = np.diff(first)
    out = [np.zeros((0, 3), np.int64)] * len(lengths)
    begin = 0
    while begin < len(lengths):
        stop = max(begin + 1, int(np.searchsorted(first, first[begin] + part, "right")) - 1)
        base = int(first[begin])
        mine = ids[base : int(first[stop])]
        if stop - begin == 1 and len(mine) > part:
            cuts = list(range(0, len(mine), part))
            rows = [_joined_runs(mine, cuts)]
            for at in cuts:
                piece = mine[at : at + part]
                rows.append(grammar_runs(piece, np.zeros(len(piece), np.int64))[0] + np.array([at, 0, at]))
            out[begin] = _merged(np.concatenate(rows))
        elif len(mine):
            owner = np.repeat(np.arange(begin, stop), lengths[begin:stop])
            rows, _ = grammar_runs(mine, owner)
            rows = rows[np.argsort(rows[:, 0], kind="stable")] if len(rows) else rows
            where = np.searchsorted(rows[:, 0] + base, first[begin : stop + 1])
            for i in range(begin, stop):
                some = rows[where[i - begin] : where[i - begin + 1]]
                if len(some):
                    shift = int(first[i]) - base
                    out[i] = _merged(some - np.array([shift, 0, shift]))
        begin = stop
    return out


def _kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, runs[:, 0] + runs[:, 1], 1)
    np.add.at(delta, runs[:, 2], -1)
    return np.cumsum(delta[:-1]) == 0


def _text_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    pieces = []
    for at in range(0, len(starts), 1 << 18):
        s = starts[at : at + (1 << 18)]
        size = ends[at : at + (1 << 18)] - s + 1
        stop = np.cumsum(size)
        take = np.arange(int(stop[-1])) + np.repeat(s - stop + size, size)
        piece = data[np.minimum(take, len(data) - 1)]
        piece[stop - 1] = 32
        pieces.append(piece.tobytes())
    return b"".join(pieces)[:-1]


def periodic_runs(docs: DataFrame, order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs``.

    Words stand between ASCII white space. A run is a stretch of words with smallest period
    ``period``, of four periods and six words at least, that no neighbouring word extends;
    ``runs`` (start, length, period) are sorted by start, then period. ``collapsed`` joins
    the words that no run holds after its first period by one space. ``order(doc_id, n)``
    may give the numbers of the words to read in place of 0 to n - 1, or None. Null and
    empty texts have no words, no runs and an empty ``collapsed``. Repeated rows get equal
    answers, extra columns are not read, an empty table gives no rows. A row's work stays
    in one task, in parts of PART_WORDS words whose grammars are joined.
    """

    def run(batch):
        names = batch.column("doc_id").to_pylist()
        ids, starts, ends, first, data = words_of(batch.column("text"))
        lengths = np.diff(first)
        if order is not None:
            for i, (name, n) in enumerate(zip(names, lengths.tolist(), strict=True)):
                turned = order(name, n)
                if turned is not None:
                    at = slice(int(first[i]), int(first[i + 1]))
                    take = first[i] + turned
                    ids[at], starts[at], ends[at] = ids[take], starts[take], ends[take]
        found = runs_of(ids, first)
        texts = []
        for i, runs in enumerate(found):
            s, e = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
            if len(runs):
                keep = _kept_words(len(s), runs)
                s, e = s[keep], e[keep]
            texts.append(_text_of(data, s, e))
        sizes = np.append(0, np.cumsum([len(r) for r in found])).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        fields = [pa.array(flat[:, 0]), pa.array(flat[:, 2] - flat[:, 0]), pa.array(flat[:, 1])]
        column = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lengths.astype(np.int64)), column, pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start: long, length: long, period: long>>"
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, runs {runs}, collapsed string")

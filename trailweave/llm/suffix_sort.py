"""Suffix sorting by prefix hashes: what op5 does with the stretches of one task.

All windows of a stretch hold its anchor, a 64-byte gram. Equal windows have it
at the same place, so two stretches share exactly the windows inside the bytes
that agree around their anchors (a stretch that has its anchor several times is
cut, so that each window goes with the first one in it). So one suffix (from the anchor on) and one reversed prefix (before
it) stand for all windows of a stretch: both are sorted, neighbours give the
longest common extensions, and only windows inside these that no neighbour
settles are sorted themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from .common import constants, mix, offsets

GRAM = 64
_BASE = constants(1, 71)[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = constants(256, 73)
_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class PrefixHashes:
    """Polynomial hashes of all prefixes of a buffer; of(i, n) is that of the n bytes at i."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer) + 1
        if len(_cache[0]) < n:
            for k, base in enumerate((_BASE, _INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _cache[k] = np.multiply.accumulate(x)
        self.down = _cache[1]
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * _cache[0][: n - 1])))

    def of(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.total[at + n] - self.total[at]) * self.down[at]


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def extension(h: PrefixHashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How many bytes agree from a and b on (before them, if back), `most` at most: binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live] + 1) // 2
        x, y = (a[live] - mid, b[live] - mid) if back else (a[live], b[live])
        same = h.of(x, mid) == h.of(y, mid)
        lo[live], hi[live] = np.where(same, mid, lo[live]), np.where(same, hi[live], mid - 1)
    return lo


def same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Whether the n bytes at a and at b are equal, for all pairs; what pairs of one distance overlap is compared once."""
    order = np.lexsort((a, b - a))
    a, b, n = a[order], b[order], n[order]
    rank = np.cumsum(np.diff(b - a, prepend=0) != 0) * (len(buffer) + 1)
    done = np.concatenate((np.zeros(1, np.int64), np.maximum.accumulate(a + n + rank)[:-1])) - rank if len(a) else a
    skip = np.minimum(np.maximum(done - a, 0), n)
    a, b, n = a + skip, b + skip, n - skip
    for lo in range(0, len(a), 4096):
        x, y, m = a[lo : lo + 4096], b[lo : lo + 4096], n[lo : lo + 4096]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        if not np.array_equal(buffer[np.repeat(x, m) + step], buffer[np.repeat(y, m) + step]):
            return False
    return True


def merge_sort(order: np.ndarray, first: np.ndarray, size: np.ndarray, less: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Sorts every run order[first : first + size] by bottom-up merging; an element's new place is its own plus its rank in the sibling run."""
    width = 1
    while len(size) and width < size.max():
        big = np.flatnonzero(size > width)
        n = size[big]
        base = np.repeat(first[big], n)
        end = base + np.repeat(n, n)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        block = i // width
        right = block % 2 == 1
        lo = base + (block ^ 1) * width
        lo, hi = np.minimum(lo, end), np.minimum(lo + width, end)
        start, me = lo.copy(), order[base + i]
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            other, mine = order[mid], me[live]
            before = np.where(right[live], ~less(mine, other), less(other, mine))
            lo[live], hi[live] = np.where(before, mid + 1, lo[live]), np.where(before, hi[live], mid)
        place = base + (block - right) * width + i % width + lo - start
        order[place] = me
        width *= 2


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and size of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


class SuffixSort:
    """The suffixes at `at`, sorted by their first `length` bytes."""

    def __init__(self, buffer: np.ndarray, hashes: PrefixHashes, at: np.ndarray, length: int):
        self.buffer, self.hashes, self.at, self.length = buffer, hashes, at, length
        self.full = hashes.of(at, length)
        head = np.zeros(len(at), np.uint64)
        for j in range(8):
            head = head << np.uint64(8) | buffer[at + j].astype(np.uint64)
        self.order = np.argsort(head, kind="stable")
        merge_sort(self.order, *_runs(head[self.order]), self.less)

    def _extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return extension(self.hashes, self.at[a], self.at[b], np.full(len(a), self.length))

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        other = np.flatnonzero(self.full[a] != self.full[b])
        if len(other):
            x, y = a[other], b[other]
            n = np.minimum(self._extension(x, y), self.length - 1)
            out[other] = self.buffer[self.at[x] + n] < self.buffer[self.at[y] + n]
        return out

    def _equal_to_next(self) -> np.ndarray | None:
        """Whether each sorted suffix but the last equals the next; None if the bytes don't bear out the order."""
        a, b = self.order[:-1], self.order[1:]
        n = self._extension(a, b)
        other = np.flatnonzero(n < self.length)
        x, y = self.at[a[other]] + n[other], self.at[b[other]] + n[other]
        if not (same_bytes(self.buffer, self.at[a], self.at[b], n) and (self.buffer[x] < self.buffer[y]).all()):
            return None
        return n == self.length

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """By suffix: whether another has the same bytes; whether it is the first of those."""
        if len(self.at) == 0:
            return np.zeros(0, bool), np.zeros(0, bool)
        same = self._equal_to_next()
        if same is None:  # a collision: hashes can't be trusted here, digests of the windows can
            return _by_digest(self.buffer, self.at, self.length)
        out, lead = np.zeros(len(self.at), bool), np.zeros(len(self.at), bool)
        out[self.order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        lead[self.order] = ~np.concatenate(([False], same))
        return out, lead


def _by_digest(buffer: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    raw = buffer.tobytes()
    first: dict[bytes, int] = {}
    which = np.array([first.setdefault(digest(raw[p : p + length]), i) for i, p in enumerate(at.tolist())], np.int64)
    return np.bincount(which, minlength=len(at))[which] > 1, which == np.arange(len(at))


class Aligned:
    """Stretches of bytes [lo, hi) with the anchor of their group at `at`, groups one after the other."""

    def __init__(self, buffer: np.ndarray, hashes: PrefixHashes, group: np.ndarray, lo: np.ndarray, at: np.ndarray, hi: np.ndarray, length: int):
        self.buffer, self.hashes, self.group, self.at, self.length = buffer, hashes, group, at, length
        self.room = {False: hi - at, True: at - lo}

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        return extension(self.hashes, self.at[a], self.at[b], np.minimum(self.room[back][a], self.room[back][b]), back)

    def less(self, a: np.ndarray, b: np.ndarray, back: bool, n: np.ndarray | None = None) -> np.ndarray:
        """By the bytes on one side of the anchor; what ends first comes first."""
        n = self.extension(a, b, back) if n is None else n
        room = self.room[back]
        out = room[a] < room[b]
        open_ = np.flatnonzero(n < np.minimum(room[a], room[b]))
        x, y = (self.at[k[open_]] + (-1 - n[open_] if back else n[open_]) for k in (a, b))
        out[open_] = self.buffer[x] < self.buffer[y]
        return out

    def sort(self, back: bool) -> np.ndarray:
        head = np.zeros(len(self.at), np.uint64)
        for j in range(8):
            step = -1 - j if back else GRAM + j
            inside = self.room[back] > (j if back else step)
            byte = np.zeros(len(head), np.uint64)
            byte[inside] = self.buffer[self.at[inside] + step]
            head = head << np.uint64(8) | byte
        order = np.lexsort((head, self.group))
        merge_sort(order, *_runs(self.group[order], head[order]), lambda a, b: self.less(a, b, back))
        return order

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """All windows as (stretch, distance from window start to anchor), one row each, and for each row: whether another stretch has that window; the same, of one before it in the sort; whether that may be so.

        What may be so and is not shown is open. Rows of distance -1 lie between
        stretches and are no windows. None if the bytes don't bear out the hashes.
        """
        least = self.length - self.room[False]
        count = self.room[True] - least + 1
        base = np.cumsum(count + 1) - count - 1
        seen, led, may = (np.zeros(int((count + 1).sum()) + 1, np.int32) for _ in range(3))

        def mark(to: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            some = first <= last
            rows, at = rows[some], base[rows[some]] - least[rows[some]]
            np.add.at(to, at + first[some], 1)
            np.add.at(to, at + last[some] + 1, -1)

        longest = {side: np.zeros(len(self.at), np.int64) for side in (False, True)}
        for back in (False, True):
            order = self.sort(back)
            for apart in (1, 2, 3):
                a, b = order[:-apart], order[apart:]
                one = self.group[a] == self.group[b]
                a, b = a[one], b[one]
                left, right = self.extension(a, b, True), self.extension(a, b, False)
                if not same_bytes(self.buffer, self.at[a] - left, self.at[b] - left, left + right):
                    return None
                if apart == 1:
                    if self.less(b, a, back, left if back else right).any():
                        return None
                    for side in (a, b):
                        np.maximum.at(longest[back], side, left if back else right)
                for to, rows in ((seen, a), (seen, b), *(((led, b),) if not back else ())):
                    mark(to, rows, self.length - right, left)
        every = np.arange(len(self.at))
        mark(may, every, np.maximum(self.length - longest[False], least), longest[True])
        row = np.repeat(every, count + 1)
        j = np.arange(len(row)) - base[row] + least[row]
        j[base + count] = -1
        return row, j, *(x.cumsum()[:-1] > 0 for x in (seen, led, may))


def ranges(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs of true."""
    edge = np.diff(flag.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeated(segments: list[bytes], anchor: np.ndarray, group: np.ndarray, wide: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ranges of windows (segment, first, last start) that another place has too; and of segments that are `wide`, each different window (segment, start, bytes' digest).

    Of the last, windows may be left out that are among the ranges and whose
    bytes another one of the same group stands for. A segment that has its
    anchor several times is cut: each window goes with the first one in it.
    """
    raw = b"".join(segments)
    buffer = np.frombuffer(raw, np.uint8)
    ends = offsets(map(len, segments))
    h = PrefixHashes(buffer)
    gram = mix(h.of(np.arange(len(buffer) - GRAM + 1), GRAM))
    at = np.flatnonzero(gram == np.repeat(anchor, np.diff(ends))[: len(gram)])
    own = np.searchsorted(ends, at, "right") - 1
    inside = at + GRAM <= ends[own + 1]
    at, own = at[inside], own[inside]
    first = np.diff(own, prepend=-1) != 0
    lo = np.where(first, ends[own], np.concatenate(([-1], at[:-1])) + 1)
    hi = np.minimum(ends[own + 1], at + length)
    some = hi - lo >= length
    at, own, lo, hi = at[some], own[some], lo[some], hi[some]
    _, number = np.unique(group, return_inverse=True)
    order = np.argsort(number[own], kind="stable")
    at, own, lo, hi = at[order], own[order], lo[order], hi[order]
    n = np.diff(ends) - length + 1
    base = np.cumsum(n + 1) - n - 1  # by segment, the place of its first window in `twice`; one free place after the last
    twice = np.zeros((n + 1).sum(), bool)
    got = Aligned(buffer, h, number[own], lo, at, hi, length).shared()
    if got:
        row, j, seen, led, may = got
        open_ = np.flatnonzero(may & ~seen)
        asked = np.zeros((number.max() + 1, length), bool)
        asked[number[own[row[open_]]], j[open_]] = True
        ask = np.flatnonzero(may)
        ask = ask[asked[number[own[row[ask]]], j[ask]]]
        seen[ask] |= SuffixSort(buffer, h, at[row[ask]] - j[ask], length).classes()[0]
        seg = own[row]
        start = at[row] - j - ends[seg]
        twice[base[seg[seen]] + start[seen]] = True
        new = (j >= 0) & ~led & wide[seg]
    else:  # hashes can't be trusted here: the digests of all windows
        seg = np.repeat(np.arange(len(segments)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        twice[base[seg] + start], new = _by_digest(buffer, ends[seg] + start, length)
        new &= wide[seg]
    first, last = ranges(twice)
    seg_of = np.searchsorted(base, first, "right") - 1
    found = seg_of, first - base[seg_of], last - base[seg_of]
    lead = seg[new], start[new]
    return *found, *lead, [digest(raw[p : p + length]) for p in (ends[lead[0]] + lead[1]).tolist()]

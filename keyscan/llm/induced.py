"""External induced sorting of suffixes, with common-prefix values.

Suffixes are L or S by whether they are larger or smaller than the suffix after them; an S suffix after an L one is a
star. Star suffixes are named by their sorted star substrings and sorted by recursion on the string of names, each name
spelled as two digits so that the alphabet stays small; a string of at most ``IN_MEMORY`` names is sorted by prefix
doubling. Star suffixes in order induce the L suffixes, these the S suffixes: scanning suffixes in order and pushing the
one before each into a priority queue by its first symbol gives them back in order. The length that two suffixes share is
one more than the least length shared between those that pushed them, so tuples carry position and common prefix through
both passes.

Everything with an entry a suffix (text, types, stars, names, order, spilled tuples) lies in files of one folder, mapped
and worked on in stretches; memory holds, for each level of the recursion, ``QUEUED`` tuples and a few stretches of
``SCANNED``, and at the last one ``IN_MEMORY`` names. Each level's names cover twice as much text as the one before.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues keep in memory before they go to disk, tuples scanned at once, and the longest string of names
#: that is sorted in memory.
QUEUED, SCANNED, IN_MEMORY = 1 << 21, 1 << 18, 1 << 22


def mapped(folder: str, name: str, kind, n: int) -> np.ndarray:
    """An array of ``n`` zeros in a file."""
    if not n:
        return np.empty(0, kind)
    return np.asarray(np.memmap(os.path.join(folder, name), kind, "w+", shape=n))


def _stretches(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(a + SCANNED, n)) for a in range(0, n, SCANNED))


def _positions(x: np.ndarray) -> type:
    return np.int32 if len(x) < 1 << 31 else np.int64


class DiskQueue:
    """A priority queue of (position, common prefix) by symbol, first in first out within a symbol.

    Induced sorting pushes the tuples of one symbol in their final order, so that this order is the priority.
    """

    def __init__(self, path: str, kind: type, limit: int = 0):
        self.path, self.kind, self.limit, self.inside = path, kind, limit or QUEUED, 0
        self.parts: dict[int, list] = defaultdict(list)
        self.file = open(path, "w+b")

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append((pos, lcp))
        self.inside += len(pos)
        if self.inside > self.limit:
            self._spill()

    def _spill(self) -> None:
        at = self.file.seek(0, os.SEEK_END)
        for parts in self.parts.values():
            first = next((k for k, part in enumerate(parts) if isinstance(part[0], np.ndarray)), len(parts))
            if first < len(parts):  # those in memory come last; they become one part
                pos, lcp = (np.concatenate(c) for c in zip(*parts[first:], strict=True))
                at_next = at + self.file.write(pos.tobytes()) + self.file.write(lcp.tobytes())
                parts[first:] = [(at, len(pos))]
                at = at_next
        self.inside = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol, those pushed meanwhile included, a bounded number at a time."""
        parts, k = self.parts[symbol], 0
        while k < len(parts):
            taken, n = [], 0
            while k < len(parts) and n < SCANNED:
                taken.append(self.load(parts, k))
                n += len(taken[-1][0])
                k += 1
            pos, lcp = (np.concatenate(c) for c in zip(*taken, strict=True))
            for a, b in _stretches(len(pos)):
                yield pos[a:b], lcp[a:b]
        del self.parts[symbol]

    def load(self, parts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Take the k-th part out of a symbol's parts, from memory or from the file."""
        part, parts[k] = parts[k], (0, 0)
        if isinstance(part[0], np.ndarray):
            self.inside -= len(part[0])
            return part
        self.file.seek(part[0])
        width = np.dtype(self.kind).itemsize
        return np.frombuffer(self.file.read(width * part[1]), self.kind), np.frombuffer(self.file.read(2 * part[1]), np.int16)

    def close(self) -> None:
        self.file.close()
        os.unlink(self.path)


def common(x: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many symbols the suffixes at a and b share, up to ``cap``."""
    out = np.zeros(len(a), np.int16)
    live = np.arange(len(a))
    n = len(x)
    for k in range(cap):
        i, j = a[live] + k, b[live] + k
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        live = live[x[i] == x[j]]
        if not len(live):
            break
        out[live] += 1
    return out


class Minima:
    """Least values of ranges of one array."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows = [values]
        step = 1
        while 2 * step <= longest:
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of each ``lo:hi``, none of them empty or longer than ``longest``."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int16)
        for level, row in enumerate(self.rows):
            at = np.flatnonzero(k == level)
            if len(at):
                out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << level)])
        return out


class Pass:
    """One inducing pass: scanned tuples push the suffixes before them that are of the wanted type.

    With ``cap`` 0 no common prefixes are kept.
    """

    def __init__(self, x, small, wanted: bool, path: str, cap: int, symbols: int):
        self.x, self.small, self.wanted, self.cap = x, small, wanted, cap
        self.queue = DiskQueue(path, _positions(x))
        self.least = np.full(symbols, cap, np.int16)  # of the common prefixes scanned since a symbol's last push
        self.begun = np.zeros(symbols, bool)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        m = len(pos)
        if not m:
            return
        before = pos - 1
        at = np.flatnonzero((before >= 0) & (self.small[before] == self.wanted))
        if not len(at):
            if self.cap:
                np.minimum(self.least, lcp.min(), out=self.least)
            return
        sym = self.x[before[at]]
        order = np.argsort(sym, kind="stable")  # 16 bits: a radix sort
        at, sym = at[order], sym[order]
        p = before[at]
        heads = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        ends = np.append(heads[1:], len(sym))
        found = sym[heads].astype(np.int64)
        if self.cap:
            lo = np.concatenate([[0], at[:-1] + 1])
            lo[heads] = 0
            shared = Minima(lcp, int((at + 1 - lo).max())).of(lo, at + 1)
            shared[heads] = np.minimum(shared[heads], self.least[found])
            shared = np.minimum(shared + 1, self.cap).astype(np.int16)
            shared[heads[~self.begun[found]]] = 0
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap)
            np.minimum(self.least, tail[0], out=self.least)
            self.least[found] = tail[at[ends - 1] + 1]
            self.begun[found] = True
        else:
            shared = np.zeros(len(p), np.int16)
        for s, a, b in zip(found.tolist(), heads.tolist(), ends.tolist(), strict=True):
            self.queue.push(s, p[a:b], shared[a:b])


def types(x: np.ndarray, folder: str) -> np.ndarray:
    """Whether each suffix is S: smaller than the one after it. The last symbol must be the only smallest."""
    n = len(x)
    small = mapped(folder, "types", np.bool_, n)
    after = small[n - 1] = True
    for a in range((n - 2) // SCANNED * SCANNED, -1, -SCANNED):
        part = x[a : min(a + SCANNED, n - 1) + 1]
        kind = np.empty(len(part) - 1, bool)
        step = np.flatnonzero(part[1:] != part[:-1])
        last = step[-1] + 1 if len(step) else 0
        if len(step):
            kind[:last] = np.repeat(part[step] < part[step + 1], np.diff(np.concatenate([[-1], step])))
        kind[last:] = after
        small[a : a + len(kind)] = kind
        after = kind[0]
    return small


def induce(x: np.ndarray, small: np.ndarray, stars: np.ndarray, shared: np.ndarray, folder: str, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in falling order, with what each shares with the larger one before it.

    ``stars``: the star suffixes in rising order, ``shared``: what each shares with the smaller one before it.
    """
    kind, symbols = _positions(x), 1 + max(int(x[a:b].max()) for a, b in _stretches(len(x)))
    seam = lambda a, b: int(common(x, np.array([a]), np.array([b]), cap)[0])
    edges = np.concatenate([[0], np.cumsum(_counts(x, stars, symbols))])
    rising = Pass(x, small, False, os.path.join(folder, "larger"), cap, symbols)
    larger = DiskQueue(os.path.join(folder, "sorted"), kind)
    for c in range(symbols):
        last = -1
        for pos, lcp in rising.queue.pop(c):
            larger.push(c, pos, lcp)
            rising.scan(pos, lcp)
            last = int(pos[-1])
        for at in range(int(edges[c]), int(edges[c + 1]), SCANNED):
            pos, lcp = stars[at : min(at + SCANNED, edges[c + 1])], shared[at : min(at + SCANNED, edges[c + 1])].copy()
            if at == edges[c]:
                lcp[0] = seam(last, pos[0]) if last >= 0 else 0
            rising.scan(pos, lcp)
    rising.queue.close()
    falling = Pass(x, small, True, os.path.join(folder, "smaller"), cap, symbols)
    for c in range(symbols - 1, -1, -1):
        last = -1
        for pos, lcp in falling.queue.pop(c):
            yield pos, lcp
            falling.scan(pos, lcp)
            last = int(pos[-1])
        chunks = larger.parts.pop(c, [])
        after = None  # what the tuple scanned before shares with this chunk's last
        for k in range(len(chunks) - 1, -1, -1):
            pos, lcp = larger.load(chunks, k)
            down, with_larger = pos[::-1], np.concatenate([[0], lcp[:0:-1]]).astype(np.int16)
            with_larger[0] = after if after is not None else (seam(last, down[0]) if last >= 0 else 0)
            after = int(lcp[0])
            for a, b in _stretches(len(down)):
                yield down[a:b], with_larger[a:b]
                falling.scan(down[a:b], with_larger[a:b])
    yield np.array([len(x) - 1], kind), np.zeros(1, np.int16)
    falling.queue.close()
    larger.close()


def _counts(x: np.ndarray, at: np.ndarray, symbols: int) -> np.ndarray:
    """How many of the positions hold each symbol."""
    out = np.zeros(symbols, np.int64)
    for a, b in _stretches(len(at)):
        out += np.bincount(x[at[a:b]], minlength=symbols)
    return out


def _stars(small: np.ndarray, folder: str, kind: type) -> np.ndarray:
    """The positions of the stars, rising."""
    path, n = os.path.join(folder, "stars"), 0
    with open(path, "wb") as out:
        for a, b in _stretches(len(small) - 1):
            found = (np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + (a + 1)).astype(kind)
            out.write(found.tobytes())
            n += len(found)
    return np.asarray(np.memmap(path, kind, "r", shape=n)) if n else np.empty(0, kind)


def doubled(x: np.ndarray, folder: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in rising order, by prefix doubling in memory, and each position's rank by its first 1, 2, 4, ... symbols."""
    n, step, key, ranks = len(x), 1, x.astype(np.int64), []
    while True:
        order = np.argsort(key)
        in_order = key[order]
        ranks.append(mapped(folder, f"ranks{len(ranks)}", np.int32, n))
        rank = ranks[-1]
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        if rank[order[-1]] == n - 1:
            return order, ranks
        key = rank.astype(np.int64) * (n + 1)
        key[: max(0, n - step)] += rank[step:] + np.int64(1)
        step *= 2


def common_names(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b of a doubled string share: by falling powers of two."""
    out, last = np.zeros(len(a), np.int64), len(ranks[0]) - 1
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][np.minimum(a + out, last)] == ranks[k][np.minimum(b + out, last)]
        out += same.astype(np.int64) << k
    return out


def _named(x: np.ndarray, star: np.ndarray, order: np.ndarray, folder: str) -> tuple[np.ndarray, bool, np.ndarray]:
    """Each star's name by its substring's rank, whether all differ, and the number of each star by its position.

    ``order``: the stars by their substrings.
    """
    number, names = mapped(folder, "numbers", np.int32 if len(star) < 1 << 31 else np.int64, len(x)), mapped(folder, "named", np.int64, len(star))
    for a, b in _stretches(len(star)):
        number[star[a:b]] = np.arange(a, b)

    def length(pos: np.ndarray) -> np.ndarray:
        n = number[pos]
        last = n == len(star) - 1
        return np.where(last, 1, star[np.where(last, n, n + 1)] - pos + 1)

    name, apart = -1, True
    for a, b in _stretches(len(order)):
        pos = order[max(0, a - 1) : b]
        if not a:
            pos = np.concatenate([pos[:1], pos])
        size = length(pos)
        same = np.zeros(b - a, bool)
        live = np.flatnonzero(size[1:] == size[:-1])
        live = live[(pos[live] != pos[live + 1])]
        left, k = size[live], 0
        while len(live):
            done = k >= left
            same[live[done]] = True
            live, left = live[~done], left[~done]
            ok = x[pos[live + 1] + k] == x[pos[live] + k]
            live, left, k = live[ok], left[ok], k + 1
        given = name + np.cumsum(~same)
        names[number[pos[1:]]] = given
        name, apart = int(given[-1]), apart and not same.any()
    return names, apart, number


def _spelled(names: np.ndarray, folder: str) -> np.ndarray:
    """The names as two digits each, none of them 0, and a 0 at the end."""
    out = mapped(folder, "digits", np.uint16, 2 * len(names) + 1)
    half = (max(1, len(names)).bit_length() + 1) // 2
    for a, b in _stretches(len(names)):
        out[2 * a : 2 * b : 2] = (names[a:b] >> half) + 1
        out[2 * a + 1 : 2 * b + 1 : 2] = (names[a:b] & ((1 << half) - 1)) + 1
    return out


def sorted_stars(x: np.ndarray, small: np.ndarray, folder: str, cap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The star suffixes in rising order, by naming star substrings and recursion; and what neighbours share, up to ``cap``.

    What they share is the star substrings of the names that they share, and what the first two others have in common.
    """
    kind = _positions(x)
    star = _stars(small, folder, kind)
    m = len(star)
    shared = mapped(folder, "shared", np.int16, m)
    if m < 2:
        return star, shared
    # an inducing pass over the unsorted stars sorts their substrings
    symbols = 1 + max(int(x[a:b].max()) for a, b in _stretches(len(x)))
    by_symbol, to = mapped(folder, "by_symbol", kind, m), np.concatenate([[0], np.cumsum(_counts(x, star, symbols))])
    for a, b in _stretches(m):
        sym = x[star[a:b]]
        turn = np.argsort(sym, kind="stable")
        sym = sym[turn].astype(np.int64)
        first = np.searchsorted(sym, sym)
        by_symbol[to[sym] + np.arange(b - a) - first] = star[a:b][turn]
        to[:-1] += np.bincount(sym, minlength=symbols)
    order, end = mapped(folder, "order", kind, m), m
    for pos, _ in induce(x, small, by_symbol, shared, folder, 0):
        mine = pos[_member(pos, small)]
        order[end - len(mine) : end] = mine[::-1]
        end -= len(mine)
    names, apart, number = _named(x, star, order, folder)
    ranks = []
    if apart:
        at, ranks = mapped(folder, "at", np.int64, m), [names]
        for a, b in _stretches(m):
            at[a:b] = number[order[a:b]]
    elif m <= IN_MEMORY:
        at, ranks = doubled(names, folder)
    else:
        inner = os.path.join(folder, "names")
        os.mkdir(inner)
        at, end = mapped(folder, "at", np.int64, m), m
        for pos, _ in falling(_spelled(names, inner), inner, 0):
            mine = pos[(pos % 2 == 0) & (pos < 2 * m)] // 2
            at[end - len(mine) : end] = mine[::-1]
            end -= len(mine)
    for a, b in _stretches(m):
        order[a:b] = star[at[a:b]]
        if cap:
            one, two = at[max(0, a - 1) : b - 1], at[max(1, a) : b]
            n = common_names(ranks, one, two) if ranks else np.zeros(len(one), np.int64)
            known = np.minimum(star[one + n] - star[one], cap).astype(np.int64)
            more = known < cap
            known[more] = np.minimum(known[more] + common(x, star[one + n][more], star[two + n][more], cap), cap)
            shared[max(1, a) : b] = known
    return order, shared


def _member(pos: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Which positions are stars."""
    return small[pos] & ~small[np.maximum(pos, 1) - 1] & (pos > 0)


def falling(x: np.ndarray, folder: str, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``x`` in falling order with what each shares, up to ``cap``, with the one before it.

    Symbols are below 65,536, and the last one must be the only smallest.
    """
    small = types(x, folder)
    stars, shared = sorted_stars(x, small, folder, cap)
    yield from induce(x, small, stars, shared, folder, cap)

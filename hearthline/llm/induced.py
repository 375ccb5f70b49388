"""Induced suffix sorting of many texts at once, with common-prefix values, over priority queues that spill to disk.

Every group of texts is sorted on its own, all groups in step: round k takes the k-th smallest symbol of each group from the
queue. Suffixes that start at a local minimum are named by their piece up to the next one; groups whose names repeat are
sorted by recursion on the names. From these seeds, tuples (symbol, position, common prefix with the tuple before) induce
the descending suffixes in rising order, then the ascending ones in falling order. A tuple's common prefix is one more than
the smallest among those taken between the two tuples that induced it and its predecessor.

Queues hold SPILL bytes of tuples at most and keep the rest in an unnamed file that goes with the task; arrays over
whole texts are mapped from such files beyond IN_MEMORY entries. Nothing is read by another task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples that a queue holds in memory. Common shards go beyond that.
SPILL = 2 << 20
#: Entries beyond which arrays over whole texts are mapped from disk.
IN_MEMORY = 2 << 20


def space(n: int, kind: type, fill: int = 0) -> np.ndarray:
    if n <= IN_MEMORY:
        return np.full(n, fill, dtype=kind)
    out = np.memmap(tempfile.TemporaryFile(), dtype=kind, shape=(n,))
    if fill:
        out[:] = fill
    return out


def slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each stretch of equal keys."""
    edges = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
    at = 0
    for end in [*edges, len(keys)]:
        yield int(keys[at]), at, end
        at = end


class Queue:
    """Tuples by symbol, of one symbol in the order of arrival; far symbols wait in blocks, which go to disk."""

    def __init__(self, symbols: int) -> None:
        self.width = max(1, int(symbols**0.5))
        self.far: dict[int, list] = {}
        self.near: dict[int, list] = {}
        self.block, self.held, self.file = -1, 0, None

    def push(self, tuples: np.ndarray) -> None:
        if tuples.shape[1] > 1:
            tuples = tuples[:, np.argsort(tuples[0], kind="stable")]
        low, high = int(tuples[0, 0]) // self.width, int(tuples[0, -1]) // self.width
        if low == high:
            self._put(low, tuples)
        else:
            for key, a, b in slices(tuples[0] // self.width):
                self._put(key, tuples[:, a:b])
        if self.held > SPILL:
            self._spill()

    def _put(self, block: int, tuples: np.ndarray) -> None:
        if block == self.block:
            self._open(tuples)
        else:
            self.far.setdefault(block, []).append(tuples)
            self.held += tuples.nbytes

    def _open(self, tuples: np.ndarray) -> None:
        if tuples[0, 0] == tuples[0, -1]:
            self.near.setdefault(int(tuples[0, 0]), []).append(tuples)
        else:
            for key, a, b in slices(tuples[0]):
                self.near.setdefault(key, []).append(tuples[:, a:b])

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.far.values():
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[k] = (self.file.seek(0, 2), part.shape)
                    self.file.write(np.ascontiguousarray(part).tobytes())
        self.held = 0

    def _read(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            self.held -= part.nbytes
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(4 * part[1][0] * part[1][1]), dtype=np.int32).reshape(part[1])

    def take(self, symbol: int) -> np.ndarray | None:
        """All tuples of the symbol that are there now."""
        if symbol // self.width != self.block:
            self.block = symbol // self.width
            if parts := self.far.pop(self.block, None):
                tuples = np.concatenate([self._read(x) for x in parts], axis=1)
                self._open(tuples[:, np.argsort(tuples[0], kind="stable")])
        parts = self.near.pop(symbol, None)
        return None if parts is None else parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)


def ascending(x: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last symbol of each group is its smallest."""
    ends = np.r_[np.flatnonzero(x[1:] != x[:-1]), len(x) - 1]
    up = np.r_[x[ends[:-1]] < x[ends[:-1] + 1], True]
    return np.repeat(up, np.diff(np.r_[-1, ends]))


def named(x: np.ndarray, up: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the pieces from each local minimum to the next, equal pieces alike: (rank over all groups, how many share it)."""
    code = x * np.int32(2) + up
    bits = max(int(code.max()).bit_length(), 1)
    step = max(1, 62 // bits)
    size = np.r_[np.diff(at), 0] + 1
    size[np.r_[group[1:] != group[:-1], True]] = 1

    def key(which: np.ndarray, done: int) -> np.ndarray:
        out = np.zeros(len(which), dtype=np.int64)
        for k in range(done, done + step):
            inside = k < size[which]
            out = (out << bits) | np.where(inside, code[np.minimum(at[which] + k, len(code) - 1)], 0)
        return out

    rank, count = np.searchsorted(group, group), np.full(len(at), 2)
    todo, done = np.arange(len(at)), 0
    while len(todo):
        k = key(todo, done)
        order = np.lexsort((k, rank[todo]))
        r, k, todo = rank[todo][order], k[order], todo[order]
        outer = np.r_[True, r[1:] != r[:-1]]
        inner = outer | np.r_[True, k[1:] != k[:-1]]
        first, sub = np.flatnonzero(outer), np.flatnonzero(inner)
        base = first[np.cumsum(outer) - 1]
        n = np.diff(np.r_[sub, len(r)])
        rank[todo] = r + (np.repeat(sub, n) - base)
        count[todo] = np.repeat(n, n)
        done += step
        todo = todo[(count[todo] > 1) & (size[todo] > done)]
    return rank, count


class Common:
    """Common prefixes of suffixes by direct comparison, up to a limit; for seeds and where two kinds of suffix meet."""

    def __init__(self, symbols: np.ndarray, limit: int) -> None:
        self.limit = limit
        padded = np.concatenate([symbols, np.zeros(limit + 16, dtype=np.uint8)])
        # Eight bytes from each place: a view of the bytes, not a copy.
        self.words = np.ndarray(len(padded) - 8, dtype="<u8", buffer=padded, strides=(1,))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(a), self.limit, dtype=np.int32), np.arange(len(a))
        for k in range(0, self.limit, 8):
            differ = self.words[a[open_] + k] ^ self.words[b[open_] + k]
            ended = differ != 0
            low = differ[ended] & (~differ[ended] + np.uint64(1))
            out[open_[ended]] = np.minimum(self.limit, k + (np.log2(low.astype(np.float64)) // 8).astype(np.int32))
            open_ = open_[~ended]
            if not len(open_):
                break
        return out


class Order:
    """One direction of the induction, without common prefixes: tuples are (symbol, place)."""

    def __init__(self, x: np.ndarray, group: np.ndarray, start: np.ndarray, up: np.ndarray, want: bool) -> None:
        self.x, self.group, self.queue, self.out = x, group, Queue(int(x.max()) + 1), []
        self.inner = np.concatenate([[False], up[:-1] == want])  # whether the place before is to be induced
        self.inner[start] = False

    def pop(self, at: np.ndarray) -> None:
        p = at[self.inner[at]] - 1
        if len(p):
            self.queue.push(np.array((self.x[p], p), dtype=np.int32))

    def step(self, symbol: int, seeds: np.ndarray | None) -> list[np.ndarray]:
        """The induced places of a symbol, then its seeds; returns the induced ones."""
        got = []
        while (t := self.queue.take(symbol)) is not None:
            got.append(t[1])
            self.pop(t[1])
        self.out += got
        if seeds is not None:
            self.out.append(seeds)
            self.pop(seeds)
        return got

    def order(self) -> np.ndarray:
        """All places taken, by group in the order in which they came."""
        at = np.concatenate(self.out)
        return at[np.argsort(self.group[at], kind="stable")]


class Pass:
    """One direction of the induction: tuples are (symbol, place, common prefix). prefixes measures where seeds meet induced tuples."""

    def __init__(self, x: np.ndarray, group: np.ndarray, start: np.ndarray, up: np.ndarray, want: bool, prefixes: Common) -> None:
        self.x, self.group, self.start, self.prefixes = x, group, start, prefixes
        self.inner = np.concatenate([[False], up[:-1] == want])
        self.inner[start] = False
        self.queue, n = Queue(int(x.max()) + 1), len(start)
        self.taken, self.last, self.last_symbol = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, -1)
        self.order = space(len(x), np.int32, -1)
        self.low = space(len(x) + 1, np.int32)
        self.first = np.r_[0, np.cumsum(np.maximum.reduceat(x, start).astype(np.int64) + 1)]
        self.before = np.full(self.first[-1], -1)

    def pop(self, symbol: int, at: np.ndarray, low: np.ndarray, seeds: bool) -> tuple[np.ndarray, np.ndarray]:
        """Takes tuples of one symbol, brought into the order of groups, and pushes what they induce."""
        g = self.group[at]
        order = np.argsort(g, kind="stable")
        at, low, g = at[order], low[order], g[order]
        heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes, owner = np.diff(np.r_[heads, len(g)]), g[heads]
        if seeds:
            low[heads] = 0
            if (met := self.last_symbol[owner] == symbol).any():
                low[heads[met]] = self.prefixes(at[heads[met]], self.last[owner[met]])
        place = np.repeat(self.start[owner] + self.taken[owner] - heads, sizes) + np.arange(len(g))
        self.taken[owner] += sizes
        self.last[owner], self.last_symbol[owner] = at[heads + sizes - 1], symbol
        self.order[place], self.low[place] = at, low
        inner = self.inner[at]
        p, place = at[inner] - 1, place[inner]
        if len(p):
            bucket = self.first[self.group[p]] + self.x[p]
            order = np.argsort(-bucket, kind="stable")  # falling, so that reduceat never runs over what lies between groups
            p, place, bucket = p[order], place[order], bucket[order]
            same = np.r_[False, bucket[1:] == bucket[:-1]]
            before = np.where(same, np.r_[-1, place[:-1]], self.before[bucket])
            ends = np.r_[~same[1:], True]
            self.before[bucket[ends]] = place[ends]
            some, new = before >= 0, np.zeros(len(p), dtype=np.int32)
            if some.any():
                pairs = np.stack([before[some] + 1, place[some] + 1], axis=1).ravel()
                new[some] = np.minimum(np.minimum.reduceat(self.low, pairs)[::2] + 1, self.prefixes.limit)
            self.queue.push(np.array((self.x[p], p, new), dtype=np.int32))
        return at, low

    def step(self, symbol: int, seeds: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The induced tuples of a symbol, then its seeds; returns the induced ones."""
        out = []
        while (t := self.queue.take(symbol)) is not None:
            out.append(self.pop(symbol, t[1], t[2], False))
        if seeds is not None:
            self.pop(symbol, *seeds, True)
        return out


def sorted_seeds(x: np.ndarray, group: np.ndarray, up: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of the local minima by group and suffix, smallest first; by recursion where their names repeat."""
    minimum = up & np.concatenate([[False], ~up[:-1]])
    minimum[start] = False
    at = np.flatnonzero(minimum)
    own = group[at]
    rank, count = named(x, up, at, own)
    if (count > 1).any():
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        again = np.repeat(np.maximum.reduceat(count, heads) > 1, np.diff(np.r_[heads, len(own)]))
        r, o, which = rank[again], own[again], np.flatnonzero(again)
        first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        names = np.searchsorted(np.unique(r), r)  # ranks grow with the group
        dense = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(o)]))
        names -= np.minimum.reduceat(names, first)[dense]
        rank[which[smallest_first(names.astype(np.int32), dense, first)]] = which
    return at[np.argsort(rank, kind="stable")]


def smallest_first(x: np.ndarray, group: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of all suffixes by group, smallest first. x: symbols, dense in each group, which ends with its only 0."""
    up = ascending(x)
    seeds = sorted_seeds(x, group, up, start)
    by = seeds[np.argsort(x[seeds], kind="stable")]
    waiting = {k: by[a:b] for k, a, b in slices(x[by])}
    symbols = int(x.max()) + 1
    rising, found = Order(x, group, start, up, False), {}
    for k in range(symbols):
        if got := rising.step(k, waiting.get(k)):
            found[k] = np.concatenate(got)[::-1]
    falling = Order(x, group, start, up, True)
    for k in range(symbols - 1, 0, -1):
        falling.step(k, found.pop(k, None))
    falling.out.append(np.concatenate([start[1:], [len(x)]]) - 1)
    order = falling.order()  # largest first
    ends = np.concatenate([start[1:], [len(x)]])
    return order[(start + ends - 1)[group] - np.arange(len(x))]


def suffix_order(x: np.ndarray, group: np.ndarray, prefixes: Common) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes by group, largest first, without a group's last symbol, and common prefixes with the one before.

    x and group as for smallest_first; a group takes as many entries as it has symbols, the last one is -1.
    """
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    up = ascending(x)
    seeds = sorted_seeds(x, group, up, start)
    low = np.zeros(len(seeds), dtype=np.int32)
    low[1:] = prefixes(seeds[:-1], seeds[1:])
    by = np.argsort(x[seeds], kind="stable")
    waiting = {k: (seeds[by[a:b]], low[by[a:b]]) for k, a, b in slices(x[seeds][by])}
    symbols = int(x.max()) + 1
    rising, found = Pass(x, group, start, up, False, prefixes), {}
    for k in range(symbols):
        if got := rising.step(k, waiting.get(k)):
            # Largest first: a tuple's common prefix with the one before it in this order is that of its neighbour.
            p, v = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            order = np.argsort(group[p], kind="stable")
            p, v = p[order][::-1], v[order][::-1]
            found[k] = (p, np.r_[np.int32(0), v[:-1]])
    falling = Pass(x, group, start, up, True, prefixes)
    for k in range(symbols - 1, 0, -1):
        falling.step(k, found.pop(k, None))
    return falling.order, falling.low[:-1]


def repeated(texts: list[bytes], groups: np.ndarray, length: int) -> np.ndarray:
    """For every string of this length in the texts, in their order, whether it starts at another place of its group too.

    groups: equal neighbours are one group. Texts hold no byte above 253, as UTF-8 never does; shorter ones hold no string.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    last = np.cumsum(sizes) - 1
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8) + np.uint8(2)  # 0xff becomes 1, the end of a text
    new = np.r_[True, groups[1:] != groups[:-1]]
    symbols[last[np.r_[new[1:], True]]] = 0
    group = np.repeat(np.cumsum(new, dtype=np.int32) - 1, sizes)
    there = np.zeros((int(group[-1]) + 1, 256), dtype=bool)
    there[group, symbols] = True
    x = (np.cumsum(there, axis=1, dtype=np.int32) - 1)[group, symbols]
    order, low = suffix_order(x, group, Common(symbols, length))
    pair = np.flatnonzero(low >= length)
    hit = np.zeros(len(symbols), dtype=bool)
    hit[order[pair]] = True
    hit[order[pair - 1]] = True
    return hit[np.repeat(last, sizes) - np.arange(len(symbols)) >= length]

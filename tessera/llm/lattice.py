"""Lattices of pieces over many short symbol sequences at once, and their shortest paths.

Lexicon: a trie of pieces as arrays, which composed with a sequence gives its lattice: one arc for
each piece that spells a stretch of it. Grammar: weights of arcs. shortest() relaxes all arcs of all
sequences by (min, +), in order of where they end, a numpy operation for each such place.

The grammar of a BPE vocabulary is an acceptor over piece pairs: a piece may follow another at
weight 0 if merging leaves the two as they are, and at infinite weight otherwise. A sequence of
pieces is what merging makes of its symbols if and only if all neighbours are allowed, so one path
of finite weight is left for every prefix. Whether a pair is allowed follows from the two merge
trees alone: walking back in time along the left piece's right spine and the right piece's left
spine, no pair of boundary symbols may have a merge that comes before theirs.

Memo: results by 64-bit hash of the sequence, in arrays of a bounded size. Two sequences that share
a hash would share a result: at a million remembered ones that is once in 2^44 look-ups.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Sequences longer than this are relaxed one by one, and the arcs of so many starts made at once.
LONG, _STARTS = 64, 1 << 15
NEVER = 1 << 30


class Table:
    """A fixed map from whole numbers to whole numbers, -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        keys, values = np.asarray(keys, dtype=np.int64), np.asarray(values, dtype=np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != -1))
        at, keys = at[todo], keys[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == keys
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            todo, at, keys = todo[on], at[on], keys[on]
        return out

    def one(self, key: int) -> int:
        at, last = (key * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits), len(self.keys) - 1
        while (held := int(self.keys[at])) != -1:
            if held == key:
                return int(self.values[at])
            at = (at + 1) & last
        return -1


class Memo:
    """Results (runs of whole numbers) by hash, in arrays of at most ENTRIES and VALUES; all are
    forgotten when either is full."""

    BITS = 19
    ENTRIES = 300_000
    VALUES = 4_000_000

    def __init__(self):
        self.keys = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.entry = np.full(1 << self.BITS, -1, dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.entry.fill(-1)
        self.ends = np.zeros(1, dtype=np.int64)
        self.values = np.zeros(0, dtype=np.int32)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        at = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = self.entry[at]
        out = np.where((found >= 0) & (self.keys[at] == hashes), found, np.int32(-1))
        todo = np.flatnonzero((found >= 0) & (out < 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.BITS) - 1)
            found = self.entry[at]
            hit = (found >= 0) & (self.keys[at] == hashes[todo])
            out[todo[hit]] = found[hit]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on]
        return out

    def room(self, entries: int) -> bool:
        return len(self.ends) - 1 + entries <= self.ENTRIES and len(self.values) <= self.VALUES

    def put(self, hashes: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        """Different new hashes with their results, one after another in values."""
        first = len(self.ends) - 1
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.values = np.concatenate([self.values, values.astype(np.int32)])
        number = np.arange(first, first + len(hashes), dtype=np.int32)
        at = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(number):
            free = self.entry[at] < 0
            self.entry[at[free]] = number[free]
            mine = self.entry[at] == number
            self.keys[at[mine]] = hashes[mine]
            number, hashes, at = number[~mine], hashes[~mine], (at[~mine] + 1) & ((1 << self.BITS) - 1)

    def sizes(self, entries: np.ndarray) -> np.ndarray:
        return self.ends[entries + 1] - self.ends[entries]

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The results of these entries, one after another."""
        return self.values[spread(self.ends[entries], self.sizes(entries))]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for sizes[0] numbers, then the same for the next."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def put_together(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These stretches of data one after another, and where each begins (one more entry)."""
    sizes = ends - starts
    return data[spread(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])


class Lexicon:
    """Trie of pieces (tuples of symbols below `symbols`), numbered in order."""

    def __init__(self, pieces: list[tuple[int, ...]], symbols: int):
        child: dict[int, int] = {}
        piece = [-1]
        for number, spelled in enumerate(pieces):
            node = 0
            for x in spelled:
                key = node * symbols + x
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(piece)
                    piece.append(-1)
            if node:
                piece[node] = number
        self.symbols = symbols
        self.piece = np.array(piece, dtype=np.int32)
        self.root = np.array([child.get(x, -1) for x in range(symbols)], dtype=np.int32)
        deeper = {k: v for k, v in child.items() if k >= symbols}
        self.child = Table(np.fromiter(deeper.keys(), np.int64, len(deeper)), np.fromiter(deeper.values(), np.int32, len(deeper)))

    def arcs(self, data: np.ndarray, place: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in data that begin at these places; end: where each
        place's sequence ends."""
        node = self.root[data[place]]
        found, length = [], 1
        while True:
            live = node >= 0
            place, node, end = place[live], node[live], end[live]
            if not len(place):
                break
            number = self.piece[node]
            hit = np.flatnonzero(number >= 0)
            found.append((place[hit], np.full(len(hit), length), number[hit]))
            inside = place + length < end
            place, node, end = place[inside], node[inside], end[inside]
            node = self.child.get(node.astype(np.int64) * self.symbols + data[place + length])
            length += 1
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Costs:
    """Grammar of one state: each piece has its weight."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    def __call__(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return self.weights[piece]

    def one(self, before: int, piece: int) -> float:
        return self.weights[piece]


class Merges:
    """Grammar of a BPE vocabulary: 0 for pairs that merging leaves alone, else infinite.

    rank: when a piece is merged, -1 for single symbols; left, right: the two that make it;
    pairs: (left, right, rank) of all merges there are. runs: for pieces that are a run of one
    symbol (`single`), whose merges tie and come last, its length, else 0; settled[a, b]: whether
    merging a run of a + b leaves it as a and b.
    """

    def __init__(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], runs: np.ndarray | None = None, settled: np.ndarray | None = None, single: int = -1):
        self.rank, self.left, self.right = (x.astype(np.int32) for x in (rank, left, right))
        self.n = np.int64(len(rank))
        self.pairs = Table(pairs[0].astype(np.int64) * self.n + pairs[1], pairs[2])
        self.runs = np.zeros(len(rank), np.int32) if runs is None else runs.astype(np.int32)
        self.longest, self.settled, self.single = int(self.runs.max(initial=0)), settled, single
        self.known: dict[tuple[int, int], float] = {}
        #: the pairs asked last, by hash: 2 * pair + whether it is allowed
        self.recent: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "recent": None}

    def __call__(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        if self.recent is None:
            self.recent = np.full(1 << 18, -1, dtype=np.int64)
        pair = before * self.n + piece
        slot = ((pair.astype(np.uint64) * _GOLDEN) >> np.uint64(46)).astype(np.int64)
        held = self.recent[slot]
        ok = (held & 1).astype(bool) | (before < 0)
        new = np.flatnonzero((held >> 1 != pair) & (before >= 0))
        if len(new):
            ok[new] = self.allowed(before[new], piece[new])
            self.recent[slot[new]] = 2 * pair[new] + ok[new]
        return np.where(ok, np.float32(0), np.float32(np.inf))

    def allowed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves each pair alone; before: if only merges of lesser rank count."""
        ok = np.ones(len(a), dtype=bool)
        x, y, todo = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
        if self.longest:
            run, other = self.runs[a], self.runs[b]
            both = (run > 0) & (other > 0)
            ok[both] = self.settled[run[both], other[both]]
            x = np.where(run > 0, self.single, x)
            todo = np.flatnonzero(~both)
            x, y = x[todo], y[todo]
        limit = np.full(len(todo), NEVER, dtype=np.int32) if before is None else before[todo].astype(np.int32)
        while len(todo):
            merge = self.pairs.get(x * self.n + y)
            crossed = (merge >= 0) & (merge < limit)
            ok[todo[crossed]] = False
            # the later of the two is undone; of equal ones the right, which comes second
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            back = rx > ry
            x, y, limit = np.where(back, self.right[x], x), np.where(back, y, self.left[y]), np.where(back, rx, ry + 1)
            todo, x, y, limit = todo[on], x[on], y[on], limit[on]
        return ok

    def one(self, before: int, piece: int) -> float:
        if before < 0:
            return 0.0
        found = self.known.get((before, piece))
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[before, piece] = 0.0 if self._allowed_one(before, piece) else np.inf
        return found

    def _allowed_one(self, x: int, y: int) -> bool:
        if self.runs[x]:
            if self.runs[y]:
                return bool(self.settled[self.runs[x], self.runs[y]])
            x = self.single
        n, limit = int(self.n), NEVER
        while True:
            if 0 <= self.pairs.one(x * n + y) < limit:
                return False
            rx, ry = int(self.rank[x]), int(self.rank[y])
            if rx < 0 and ry < 0:
                return True
            x, y, limit = (int(self.right[x]), y, rx) if rx > ry else (x, int(self.left[y]), ry + 1)


def _relax_one(lexicon: Lexicon, grammar: Costs | Merges, data: np.ndarray, last: np.ndarray, back: np.ndarray, first: int) -> None:
    """Fills in last and back, from node `first` on, for one long sequence; its arcs are made a block
    of starts at a time."""
    weight, piece_before = [0.0] + [np.inf] * len(data), [-1] * (len(data) + 1)
    for at in range(0, len(data), _STARTS):
        place = np.arange(at, min(at + _STARTS, len(data)))
        start, length, piece = lexicon.arcs(data, place, np.full(len(place), len(data)))
        order = np.argsort(start, kind="stable")
        for t, size, p in zip(start[order].tolist(), length[order].tolist(), piece[order].tolist(), strict=True):
            # arcs that start earlier come first, so the longest of equal ones stays
            if weight[t] < weight[t + size]:
                cost = weight[t] + grammar.one(piece_before[t], p)
                if cost < weight[t + size]:
                    weight[t + size], piece_before[t + size] = cost, p
                    back[first + t + size] = first + t
    last[first : first + len(data) + 1] = piece_before


def shortest(lexicon: Lexicon, grammar: Costs | Merges, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces on the shortest paths of all sequences, one after another.

    begins: where each sequence begins in data, with one more entry; every single symbol must have
    an arc. Returns (pieces, where each ends in data, pieces of each sequence). Of equal paths the
    one whose last arc is longest is taken.
    """
    n = len(begins) - 1
    size = np.diff(begins)
    of = np.repeat(np.arange(n), size)
    # one node more than symbols for each sequence
    nodes = len(data) + n
    weight = np.full(nodes, np.inf, dtype=np.float32)
    weight[begins[:-1] + np.arange(n)] = 0
    last, back = np.full(nodes, -1, dtype=np.int32), np.full(nodes, -1, dtype=np.int64)
    place = np.flatnonzero((size <= LONG)[of])
    start, length, piece = lexicon.arcs(data, place, begins[1:][of[place]])
    tail = start + of[start]
    head = tail + length
    depth = start - begins[of[start]] + length
    # within a step shorter arcs first, so that the longest of equal ones is written last
    order = np.argsort(depth.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, LONG + 2))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        some = order[a:b]
        t, h, p = tail[some], head[some], piece[some]
        cost = weight[t] + grammar(last[t], p)
        np.minimum.at(weight, h, cost)
        best = (cost == weight[h]) & np.isfinite(cost)
        last[h[best]], back[h[best]] = p[best], t[best]
    for i in np.flatnonzero(size > LONG).tolist():
        _relax_one(lexicon, grammar, data[begins[i] : begins[i + 1]], last, back, int(begins[i]) + i)
    on = np.zeros(nodes, dtype=bool)
    at = begins[1:] + np.arange(n)
    at = at[size > 0]
    while len(at):
        on[at] = True
        at = back[at]
        at = at[last[at] >= 0]
    path = np.flatnonzero(on)
    sums = np.concatenate([[0], np.cumsum(on)])
    edges = begins + np.arange(n + 1)
    counts = sums[edges[1:]] - sums[edges[:-1]]
    return last[path], path - np.repeat(np.arange(n), counts), counts

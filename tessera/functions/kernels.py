"""The same distances for blocks of vectors, in numpy.

Where a distance has no meaning (the cosine of a zero vector, a ratio by zero) it is NaN here and
null as a Column; a search never returns such a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Distances are ranked after rounding to this many units; ties are broken by id.
UNITS = 1e6
#: Queries whose distances to a step of the base are held at once.
TILE = 256
#: Vectors of a cell, and the dimension from which on cells rule nothing out.
CELL, CELL_DIMENSIONS = 256, 8


def rounded(d: np.ndarray) -> np.ndarray:
    return np.floor(d * UNITS + 0.5) / UNITS


def tiles(n: int) -> Iterator[np.ndarray]:
    """0 .. n - 1 in runs of TILE, so that a matrix of distances has one size for any block."""
    for at in range(0, n, TILE):
        yield np.arange(at, min(at + TILE, n))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, d) of a list column without nulls, in double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _wide(q: np.ndarray, x: np.ndarray, f) -> np.ndarray:
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 22) // max(1, x.size))
    for i in range(0, len(q), step):
        out[i : i + step] = f(q[i : i + step, None, :], x[None, :, :])
    return out


def _squared_l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if 0 < q.shape[1] < 8:
        # a coordinate at a time: the same sum, without a matrix of d values a pair
        out, left = np.subtract.outer(q[:, 0], x[:, 0]), None
        out *= out
        for j in range(1, q.shape[1]):
            left = np.subtract(q[:, j, None], x[None, :, j], out=left)
            left *= left
            out += left
        return out
    if q.shape[1] <= 8:
        return _wide(q, x, lambda a, b: ((a - b) ** 2).sum(axis=2))
    return np.maximum((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * (q @ x.T), 0)


def _whole_l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of vectors of whole numbers, exactly."""
    q, x = q.astype(np.int64), x.astype(np.int64)
    return ((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * (q @ x.T)).astype(np.float64)


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])


def _canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.abs(a - b) / (np.abs(a) + np.abs(b))).sum(axis=2)


def _jensen_shannon(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = (a + b) / 2
    return 0.5 * (-a * np.log(m / a) - b * np.log(m / b)).sum(axis=2)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(b != 0, a / b, np.nan)


KERNELS = {
    "l2": _squared_l2,
    "ip": lambda q, x: q @ x.T,
    "cosine": _cosine,
    "ip_distance": lambda q, x: 1 - q @ x.T,
    "cosine_distance": lambda q, x: 1 - _cosine(q, x),
    "l2_whole": _whole_l2,
    "l1": lambda q, x: _wide(q, x, lambda a, b: np.abs(a - b).sum(axis=2)),
    "linf": lambda q, x: _wide(q, x, lambda a, b: np.abs(a - b).max(axis=2)),
    "lp": lambda q, x: _wide(q, x, lambda a, b: (np.abs(a - b) ** 3.0).sum(axis=2)),
    "canberra": lambda q, x: _wide(q, x, _canberra),
    "bray_curtis": lambda q, x: _wide(q, x, lambda a, b: _ratio(np.abs(a - b).sum(axis=2), np.abs(a + b).sum(axis=2))),
    "jensen_shannon": lambda q, x: _wide(q, x, _jensen_shannon),
    "jaccard": lambda q, x: _wide(q, x, lambda a, b: _ratio(np.minimum(a, b).sum(axis=2), np.maximum(a, b).sum(axis=2))),
}


def members(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, position) of each member of runs of positions."""
    each = np.repeat(np.arange(len(n)), n)
    return each, begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)


def runs_of_equals(x: np.ndarray, ids: np.ndarray, before: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order (by `before`, its last key first) in which equal vectors lie side by
    side with rising ids, and where each run of them begins there. Equal vectors make one run, but
    for those with others between them that differ after four coordinates only."""
    order = np.lexsort((ids, *(x[:, j] for j in range(min(4, x.shape[1]))), *before))
    y, name = x[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (y[1:] != y[:-1]).any(axis=1) | (name[1:] < name[:-1])
    for key in before:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


def cells(x: np.ndarray, most: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin): an order in which vectors near each other lie side by side in cells of `most` at
    most, and where each cell begins there. group: none shares a cell with another; it rises."""
    order, cell = np.arange(len(x)), np.zeros(len(x), dtype=int) if group is None else group
    while True:
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(x) else np.zeros(0, dtype=int)
        size = np.diff(np.append(begin, len(x)))
        if not len(x) or size.max() <= most:
            return order, begin
        # all cells that are too large are halved along their longest side
        y, which = x[order], np.repeat(np.arange(len(size)), size)
        axis = (np.fmax.reduceat(y, begin) - np.fmin.reduceat(y, begin)).argmax(axis=1)
        order = order[np.lexsort((y[np.arange(len(y)), axis[which]], which))]
        far = np.arange(len(x)) - begin[which] >= (size // 2)[which]
        cell = 2 * which + (far & (size > most)[which])


def gaps(low: np.ndarray, high: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Euclidean distances of boxes low .. high to below .. above: one of them may be points."""
    return np.sqrt((np.maximum(0, np.maximum(low - above, below - high)) ** 2).sum(axis=-1))


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.nonzero, faster where little is set."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def _kth_row(keys: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """For each line of keys its k-th least (the last, if there are fewer), column j counted n[j] times."""
    m = min(k, keys.shape[1])
    first = np.argpartition(keys, m - 1, axis=1)[:, :m]
    least = np.take_along_axis(keys, first, axis=1)
    order = np.argsort(least, axis=1)
    enough = np.cumsum(np.take_along_axis(n[first], order, axis=1), axis=1) >= k
    enough[:, -1] = True
    return np.take_along_axis(least, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]


class Best:
    """The k nearest so far of each query, by (rounded distance, id)."""

    def __init__(self, queries: int, k: int, greater: bool):
        self.k, self.sign = k, -1.0 if greater else 1.0
        self.keys = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, distances: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None, copies: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """distances: (len(rows), columns) for these queries; allowed masks them. A column is a row of
        ids, or, with copies (first row, how many), a run of rows with rising ids, of which none
        beyond the k-th can be among the k nearest."""
        keys, worst = (-distances if self.sign < 0 else distances), self.keys[rows, -1]
        # what rounds to more than the k-th is out; so are NaN and infinity
        near = keys < (worst + 1 / UNITS)[:, None]
        if allowed is not None:
            near &= allowed
        # a column of many rows fills k alone, so the columns beyond are cut before rows are looked at
        heavy = copies is not None and len(copies[1]) and copies[1].max() > 1
        most = 4 if heavy else 4 * self.k
        i, j = _places(near)
        if keys.shape[1] > most:
            many = np.flatnonzero(np.bincount(i, minlength=len(near)) > most)
            if len(many):
                # all that tie with the k-th come along
                some = np.where(near[many], keys[many], np.inf)
                edge = _kth_row(some, copies[1], self.k) if heavy else np.partition(some, self.k - 1, axis=1)[:, self.k - 1]
                near[many] &= some <= edge[:, None] + 1 / UNITS
                i, j = _places(near)
        if not len(i):
            return
        key = rounded(keys[i, j])
        if copies is not None:
            each, j = members(copies[0][j], np.minimum(copies[1][j], self.k))
            i, key = i[each], key[each]
        name = ids[j]
        better = np.flatnonzero((key < worst[i]) | (key == worst[i]) & (name < self.ids[rows, -1][i]))
        if not len(better):
            return
        u, who = np.unique(i[better], return_inverse=True)
        at = rows[u]
        every, names = np.concatenate([self.keys[at].ravel(), key[better]]), np.concatenate([self.ids[at].ravel(), name[better]])
        who = np.concatenate([np.repeat(np.arange(len(u)), self.k), who])
        order = np.lexsort((names, every, who))
        begin = np.searchsorted(who[order], np.arange(len(u)))
        order = order[begin[:, None] + np.arange(self.k)]
        self.keys[at], self.ids[at] = every[order], names[order]

    def scan(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, kernel, allowed: np.ndarray | None = None, copies: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Offers all vectors x to all queries q, a tile of queries at a time."""
        for rows in tiles(len(q)):
            self.offer(rows, kernel(q[rows], x), ids, None if allowed is None else allowed[rows], copies)

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """The Euclidean distance beyond which nothing is among these queries' k nearest by squared
        distance: what rounds to the k-th may still be before it by its id."""
        return np.sqrt(np.maximum(self.keys[rows, -1], 0) + 1 / UNITS) * (1 + 1e-9) + 1e-9

    def scan_cells(self, q: np.ndarray, cuts: np.ndarray, x: np.ndarray, begin: np.ndarray, ids: np.ndarray, kernel, copies: tuple[np.ndarray, np.ndarray], turn: np.ndarray | None = None, bound=None) -> None:
        """As scan, by squared Euclidean distances, but only cells that can hold one of the k nearest:
        the queries of a cell (of cuts) meet those of x (of begin) from the nearest outwards. turn: the
        numbers of the queries; bound: as self.bound, for another kernel."""
        turn, bound = np.arange(len(q)) if turn is None else turn, bound or self.bound
        low, high, end = np.fmin.reduceat(x, begin), np.fmax.reduceat(x, begin), np.append(begin[1:], len(x))
        for a, b in zip(cuts, np.append(cuts[1:], len(q)), strict=True):
            far = gaps(low, high, np.fmin.reduce(q[a:b]), np.fmax.reduce(q[a:b]))
            edge = bound(turn[a:b])
            for cell in np.argsort(far, kind="stable"):
                if far[cell] > edge.max():
                    break
                rows = np.flatnonzero(gaps(low[cell], high[cell], q[a:b], q[a:b]) <= edge)
                if len(rows):
                    held = slice(begin[cell], end[cell])
                    self.offer(turn[a + rows], kernel(q[a + rows], x[held]), ids, None, (copies[0][held], copies[1][held]))
                    edge[rows] = bound(turn[a + rows])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, distance) of all that were found."""
        at, column = np.nonzero(np.isfinite(self.keys))
        return at, self.ids[at, column], self.sign * self.keys[at, column]

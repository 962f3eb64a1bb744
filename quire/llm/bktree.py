"""BK-trees over 64-bit fingerprints, built and searched a level at a time for many fingerprints at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class BKTree:
    """Children are keyed by their Hamming distance to the parent.

    Nodes are kept in arrays; edges are sorted by (parent, distance), so the edges that a search may follow
    from a node, those with a key within the radius of its own distance, are one slice.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints = np.ascontiguousarray(prints, dtype=np.uint64)
        n = len(prints)
        edges, at, left = [], np.zeros(max(n - 1, 0), dtype=np.int64), np.arange(1, n)
        while len(left):
            # All that wait below a node at the same distance: the first becomes the child, the rest go on below it.
            key = at * 65 + np.bitwise_count(prints[left] ^ prints[at])
            order = np.argsort(key, kind="stable")
            key, left = key[order], left[order]
            first = np.r_[True, key[1:] != key[:-1]]
            child = left[first][np.cumsum(first) - 1]
            edges.append((key[first], left[first]))
            at, left = child[~first], left[~first]
        keys = np.concatenate([k for k, _ in edges]) if edges else np.empty(0, np.int64)
        children = np.concatenate([c for _, c in edges]) if edges else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def search(self, queries: np.ndarray, radius: int, frontier: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (query index, node index) of all pairs within the radius, in parts of bounded size."""
        if not len(self.prints):
            return
        queries = np.ascontiguousarray(queries, dtype=np.uint64)
        stack = [(np.arange(s, min(s + frontier, len(queries))), None) for s in range(0, len(queries), frontier)]
        while stack:
            q, node = stack.pop()
            node = np.zeros(len(q), dtype=np.int64) if node is None else node
            d = np.bitwise_count(queries[q] ^ self.prints[node]).astype(np.int64)
            if (hit := d <= radius).any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            total = np.cumsum(hi - lo)
            start = 0
            while start < len(q) and total[-1]:
                done = total[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(total, done + frontier, "right")))
                n = (hi - lo)[start:stop]
                if n.sum():
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    stack.append((np.repeat(q[start:stop], n), self.children[np.repeat(lo[start:stop], n) + within]))
                start = stop


class Unions:
    """Disjoint sets of 0 to n - 1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[self.up[x]]
            if (y == self.up[x]).all():
                return y
            self.up[x] = y

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def spanning(prints: np.ndarray, radius: int, bits: tuple[int, int] = (0, 64), limit: int = 4096, accept=None) -> np.ndarray:
    """root of each fingerprint: sets of those joined by steps of at most ``radius`` bits.

    Distinct fingerprints are expected. More than ``limit`` of them are split by parts of the bits in the range
    ``bits``: two within the radius agree in at least one of radius + 1 parts, so each pair meets in a smaller tree.
    """
    sets = Unions(len(prints))
    _span(prints, np.arange(len(prints)), radius, bits, limit, sets, accept)
    return sets.roots(np.arange(len(prints)))


def _span(prints, members, radius, bits, limit, sets, accept) -> None:
    lo, hi = bits
    if len(members) <= limit or hi - lo <= radius:
        for q, node in BKTree(prints[members]).search(prints[members], radius):
            keep = q < node
            a, b = members[q[keep]], members[node[keep]]
            if accept is None:
                sets.add(a, b)
                continue
            for at in range(0, len(a), 1 << 14):
                x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                apart = sets.roots(x) != sets.roots(y)
                x, y = x[apart], y[apart]
                good = accept(x, y)
                sets.add(x[good], y[good])
        return
    edges = [lo + (hi - lo) * i // (radius + 1) for i in range(radius + 2)]
    for s, e in zip(edges, edges[1:]):
        part = (prints[members] >> np.uint64(s)) & np.uint64((1 << (e - s)) - 1)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(members[order], cuts):
            if len(group) > 1:
                # Any range of bits will do for a further split: go on in the larger one beside this part.
                _span(prints, np.sort(group), radius, (e, hi) if hi - e >= s - lo else (lo, s), limit, sets, accept)

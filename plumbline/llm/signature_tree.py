"""Similar pairs among the sets of one block, by dual traversal of a signature tree.

A leaf is a set with a bitmap of its elements' hashes. A node holds the OR of its children's bitmaps, the range of
their sizes and their greatest excess (elements that share a bit within their set). Two sets of two nodes have at most
popcount(A & B) + min(excess) elements in common; pairs of nodes that stay below the threshold for every size in their
ranges are pruned, as are nodes that already lie in one component. Leaf pairs that are left are compared exactly.
"""

from __future__ import annotations

import numpy as np

FAN = 4


class Forest:
    """Union-find over positions."""

    def __init__(self, labels: np.ndarray):
        self.parent = np.arange(len(labels))
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[back]

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = int(self.parent[k])
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def similar_enough(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def spanning_links(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions with Jaccard similarity of at least `percent`, as many as connect what is connected.

    sets: sorted distinct uint64 hashes, none empty. labels: sets of one label are known to be connected.
    """
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)

    def similar(i: int, j: int) -> bool:
        x, y = sets[order[i]], sets[order[j]]
        return similar_enough(_common(x, y), len(x), len(y), percent)

    order = np.lexsort((sizes, np.array([s[0] for s in sets])))  # similar sets mostly share their least hash
    words = _words(sizes, m)
    bits = np.zeros((m, words), np.uint64)
    for row, k in enumerate(order.tolist()):
        at = sets[k] & np.uint64(64 * words - 1)
        np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return _span(bits, sizes[order], labels[order], order, percent, similar)


def possible_links(bitmaps: list[bytes], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions whose bitmaps leave it possible that the sets are similar, as many as connect all such pairs.

    Bitmaps have a power of two of bits, 64 at least; wider ones are folded to the width of the narrowest.
    """
    m = len(bitmaps)
    if m < 2:
        return []
    least = min(map(len, bitmaps)) // 8
    bits = np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, least), axis=0) for b in bitmaps])
    sizes = np.asarray(sizes, np.int64)
    order = np.lexsort((sizes, bits[:, 0] & np.uint64(0xFFFF)))
    return _span(bits[order], sizes[order], np.arange(m), order, percent, None)


def _span(bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, order: np.ndarray, percent: int, similar) -> list[tuple[int, int]]:
    """Spanning links of the sets in tree order; `similar` compares two leaves that are not pruned (None: they count)."""
    words = bits.shape[1]
    excess = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
    levels = [(bits, sizes, sizes, excess)]
    while len(levels[-1][0]) > 1:
        levels.append(_parents(*levels[-1]))
    forest = Forest(labels)
    out: list[tuple[int, int]] = []
    chunk = max(1, (1 << 18) // (words * FAN * FAN))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    known, spans = -1, []
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            stack.append((level, a[chunk:], b[chunk:]))
            a, b = a[:chunk], b[:chunk]
        if known != len(out):
            known, spans = len(out), _label_spans(forest.labels(), len(levels))
        low, high = spans[level]
        open_ = (low[a] != low[b]) | (high[a] != high[b]) | (low[a] != high[a])
        a, b = a[open_], b[open_]
        use = _possible(levels[level], a, b, percent)
        a, b = a[use], b[use]
        if not len(a):
            continue
        if level == 0:
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if i != j and forest.find(i) != forest.find(j) and (similar is None or similar(i, j)):
                    forest.join(i, j)
                    out.append((int(order[i]), int(order[j])))
            continue
        below = len(levels[level - 1][0])
        x = (a[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
        y = (b[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
        real = (x < below) & (y < below) & (x <= y)
        x, y = x[real], y[real]
        own = x == y  # a node with itself first: its links make other pairs needless
        stack.append((level - 1, x[~own], y[~own]))
        stack.append((level - 1, x[own], y[own]))
    return out


def _words(sizes: np.ndarray, m: int) -> int:
    """Words of a bitmap: four bits an element of the largest set, and at most 32 MB in all."""
    want = 1 << max(0, int(4 * sizes.max() - 1).bit_length() - 6)
    most = 1 << max(0, ((1 << 22) // m).bit_length() - 1)
    return int(min(want, most))


def _parents(bits: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, ...]:
    first = np.arange(0, len(bits), FAN)
    return (
        np.bitwise_or.reduceat(bits, first, axis=0),
        np.minimum.reduceat(low, first),
        np.maximum.reduceat(high, first),
        np.maximum.reduceat(excess, first),
    )


def _possible(level: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    bits, low, high, excess = level
    sized = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
    common = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(excess[a], excess[b])
    common = np.minimum(common, np.minimum(high[a], high[b]))
    return sized & ((100 + percent) * common >= percent * (low[a] + low[b]))


def _label_spans(labels: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest component of each node, by level."""
    out = [(labels, labels)]
    while len(out) < depth:
        low, high = out[-1]
        first = np.arange(0, len(low), FAN)
        out.append((np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)))
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())

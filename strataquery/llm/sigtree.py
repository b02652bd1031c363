"""Signature trees over token sets, joined by dual traversal.

Leaves are sets; a node holds the OR of its leaves' token bitmaps, their size range, and the largest number of tokens
that a leaf loses to bitmap collisions. Two nodes are pruned when no pair below them can reach the similarity: shared
bits plus lost tokens bound the overlap, sizes bound the ratio. Pairs already joined through others are skipped, for
only what is reachable counts. Surviving leaf pairs are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
MEMORY = 1 << 25


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 |x & y| >= 80 |x | y| for sorted distinct arrays; empty ones are similar to nothing."""
    if not len(x) or not len(y) or 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return 9 * shared >= 4 * (len(x) + len(y))


class Labels:
    """Union-find over 0 .. n - 1, starting from given labels."""

    def __init__(self, start: np.ndarray) -> None:
        _, first, where = np.unique(start, return_index=True, return_inverse=True)
        self.parent = first[where].astype(np.int64)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def all(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                return p
            p = self.parent = q


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sets), width // 64), np.uint64)
    for i, s in enumerate(sets):
        bits = np.zeros(width, bool)
        bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
        out[i] = np.packbits(bits).view(np.uint64)
    return out


class Level:
    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, lost: np.ndarray, label: np.ndarray) -> None:
        self.bits, self.low, self.high, self.lost, self.label = bits, low, high, lost, label

    def up(self) -> Level:
        """Parents of FAN nodes each; label -1 where the leaves below differ in it."""
        at = np.arange(0, len(self.low), FAN)
        same = np.minimum.reduceat(self.label, at) == np.maximum.reduceat(self.label, at)
        return Level(
            np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at),
            np.maximum.reduceat(self.lost, at), np.where(same & (self.label[at] >= 0), self.label[at], -1),
        )

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a similar pair."""
        may = (5 * self.high[a] >= 4 * self.low[b]) & (5 * self.high[b] >= 4 * self.low[a]) & ((self.label[a] < 0) | (self.label[a] != self.label[b]))
        i = np.flatnonzero(may)
        step = max(1, MEMORY // (self.bits.shape[1] * 8))
        for k in range(0, len(i), step):
            j = i[k : k + step]
            x, y = a[j], b[j]
            shared = np.bitwise_count(self.bits[x] & self.bits[y]).sum(1, dtype=np.int64) + np.minimum(self.lost[x], self.lost[y])
            may[j] = 9 * shared >= 4 * (self.low[x] + self.low[y])
        return may


def survivors(levels: list[Level], labels: Labels, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs that no bound rules out, by depth-first dual traversal in bounded pieces. levels: leaves first."""
    n = len(levels[-1].low)
    a, b = np.triu_indices(n)
    stack = [(len(levels) - 1, a, b)]
    two = block.max() != block.min()
    while stack:
        depth, a, b = stack.pop()
        if depth == 0:
            now = labels.all()
            keep = (a != b) & (now[a] != now[b])
            if two:
                keep &= block[a] != block[b]
            a, b = a[keep], b[keep]
        may = levels[depth].possible(a, b)
        if depth == 0:
            yield a[may], b[may]
            continue
        keep = may | (a == b)
        a, b = a[keep], b[keep]
        below = len(levels[depth - 1].low)
        piece = 2048
        for k in range(0, len(a), piece):
            x = (a[k : k + piece, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
            y = (b[k : k + piece, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
            ok = (x < below) & (y < below) & (x <= y)
            stack.append((depth - 1, x[ok], y[ok]))


def spanning_links(sets: list[np.ndarray], start: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of indices) that connect whatever similar pairs connect, given what `start` connects already.

    Where `block` has two values, pairs within one are left out (another call has them)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], np.uint64), sizes, block))
    sets, sizes, block, start = [sets[i] for i in order], sizes[order], block[order], start[order]
    labels, out = Labels(start), []

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            for i, j in zip(a[:128].tolist(), b[:128].tolist(), strict=True):
                p, q = labels.find(i), labels.find(j)
                if p != q and similar(sets[i], sets[j]):
                    labels.parent[max(p, q)] = min(p, q)
                    out.append((int(order[i]), int(order[j])))
            a, b = a[128:], b[128:]
            now = labels.all()
            keep = now[a] != now[b]
            a, b = a[keep], b[keep]

    width = 1 << min(16, max(8, int(4 * sizes.max() - 1).bit_length()))
    bits = bitmaps(sets, width)
    _, label = np.unique(start, return_inverse=True)
    levels = [Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1, dtype=np.int64), label.astype(np.int64))]
    while len(levels[-1].low) > FAN:
        levels.append(levels[-1].up())
    for a, b in survivors(levels, labels, block):
        settle(a, b)
    return out

"""Vantage-point trees over 64-bit fingerprints under Hamming distance.

A node has a vantage point and a distance: fingerprints within it are *inside*, the others *outside*. Two
fingerprints within radius r of each other differ by at most r in their distances to the vantage point (triangle
bound), so a pair that is split has an inside member whose distance is above ``split - r``. Such members are also sent
outside as *guests*; guests meet the residents of a leaf but not each other. Each linked pair so meets in the leaf
where one of the two is resident.

``Shards`` is the upper tree, grown from a bounded sample of vantage points, which deals fingerprints to tasks;
``links`` is the join inside one task, which goes on splitting the same way.
"""
from __future__ import annotations

import numpy as np

LEAF_PAIRS = 1 << 16
BLOCK = 1 << 18
FLUSH = 1 << 20
CORE = 16


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Shards:
    """The upper tree: nodes hold (vantage, split, inside, outside); a negative child is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius = radius
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.leaves = 0
        rng = np.random.default_rng(7)
        self.root = self._grow(np.unique(sample), leaves, rng)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves <= 1 or len(sample) < 8:
            return self._leaf()
        # of a few candidates the one whose distances spread most prunes best
        tries = rng.choice(sample, min(16, len(sample)), replace=False)
        vantage = max(tries, key=lambda v: float(distance(sample, v).std()))
        d = distance(sample, vantage)
        split = int(np.median(d))
        if not (d <= split).any() or not (d > split).any():
            split = int(d.min())
            if not (d > split).any():
                return self._leaf()
        at = len(self.nodes)
        self.nodes.append((vantage, split, 0, 0))
        inside = self._grow(sample[d <= split], leaves // 2, rng)
        outside = self._grow(sample[d > split], leaves - leaves // 2, rng)
        self.nodes[at] = (vantage, split, inside, outside)
        return at

    def deal(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in prints, leaf, resident) of every visit that the fingerprints make."""
        out = []
        todo = [(self.root, np.arange(len(prints)), np.ones(len(prints), bool))]
        while todo:
            node, who, resident = todo.pop()
            if not len(who):
                continue
            if node < 0:
                out.append((who, np.full(len(who), -node - 1), resident))
                continue
            vantage, split, inside, outside = self.nodes[node]
            d = distance(prints[who], vantage).astype(np.int64)
            near = d <= split
            # residents stay on their side; those near the border are guests outside; guests go wherever a partner may live
            into = np.where(resident, near, d <= split + self.radius)
            beyond = d > split - self.radius
            todo.append((inside, who[into], resident[into]))
            todo.append((outside, who[beyond], (resident & ~near)[beyond]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            return label


class _Links:
    """Pairs gathered so far, cut down to a spanning forest whenever there are many."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.size += len(a)
        if self.size > FLUSH:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.parts:
            a, b = (np.concatenate(x) for x in zip(*self.parts))
            every = np.arange(len(self.label))
            self.label = roots(len(every), np.concatenate([a, every]), np.concatenate([b, self.label]))
            self.parts, self.size = [], 0
        return self.label


def _meet(prints, left, right, radius, links) -> None:
    """All pairs of two sets, in blocks of bounded size."""
    if not len(left) or not len(right):
        return
    other = prints[right]
    step = max(1, BLOCK // len(right))
    for at in range(0, len(left), step):
        mine = left[at:at + step]
        i, j = np.nonzero(distance(prints[mine][:, None], other[None, :]) <= radius)
        if len(i):
            a, b = mine[i], right[j]
            real = a != b
            links.add(a[real], b[real])


def links(residents: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among residents and between residents and guests.

    Fingerprints within the radius of a vantage point that is one of them are linked to it and need not meet each other; only those of
    the shell around them (up to twice the radius) can be linked to them otherwise. A dense group is so peeled off ball by
    ball without comparing its pairs.
    """
    prints = np.concatenate([residents, guests])
    found = _Links(len(prints))
    rng = np.random.default_rng(11)
    n = len(residents)
    todo = [(np.arange(n), np.arange(n, len(prints)))]
    while todo:
        home, extra = todo.pop()
        if not len(home):
            continue
        if len(home) * (len(home) + len(extra)) <= LEAF_PAIRS:
            _meet(prints, home, np.concatenate([home, extra]), radius, found)
            continue
        v = home[rng.integers(len(home))]
        dh, dx = (distance(prints[w], prints[v]).astype(np.int64) for w in (home, extra))
        ball, guest_ball = home[dh <= radius], extra[dx <= radius]
        if len(ball) + len(guest_ball) >= CORE:
            members = np.concatenate([ball, guest_ball])
            found.add(members, np.full(len(members), v))
            shell, guest_shell = home[(dh > radius) & (dh <= 2 * radius)], extra[(dx > radius) & (dx <= 2 * radius)]
            _meet(prints, ball, np.concatenate([shell, guest_shell]), radius, found)
            _meet(prints, shell, guest_ball, radius, found)
            todo.append((home[dh > radius], extra[dx > radius]))
            continue
        split = int(np.median(dh))
        if (dh <= split).all():
            split -= 1
        near = dh <= split
        if not near.any() or near.all():
            _meet(prints, home, np.concatenate([home, extra]), radius, found)
            continue
        todo.append((home[near], extra[dx <= split + radius]))
        todo.append((home[~near], np.concatenate([home[near & (dh > split - radius)], extra[dx > split - radius]])))
    label = found.flush()
    child = np.flatnonzero(label != np.arange(len(prints)))
    return prints[child], prints[label[child]]

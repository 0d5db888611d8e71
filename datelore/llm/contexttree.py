"""Context-tree weighting over bytes, each byte taken as eight binary decisions.

For every decision (a prefix of the byte's bits) the contexts of 0 to ``depth`` preceding bytes form a
tree. A node's Krichevsky-Trofimov estimate of its own counts and the product over its children are
mixed half and half, from the leaves up, so that a prediction is a mixture over all depths. A
context that is given no node of its own is one with a node's other such contexts, together one more child.

Contexts that end with the same bytes are a branch: all that weighing and predicting there needs is the branch itself and the levels
of the shorter contexts above it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

#: Stands before and after a text; no UTF-8 text holds it.
EDGE = 0xFF
HALF = np.log(0.5)
#: Grams worked out together, each of which takes eight bits at every level.
AT_ONCE = 1 << 17
#: Counts below this find their logarithms in a table.
COUNTS = 1 << 16


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function, x > 0: shifted up by eight, then Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


@functools.cache
def gammas() -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the gamma function at n + 0.5 and at n + 1, for n below ``COUNTS``."""
    n = np.arange(COUNTS)
    return log_gamma(n + 0.5), log_gamma(n + 1)


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts, which are whole numbers."""
    if np.size(zeros) > 8 * AT_ONCE:
        return np.concatenate([log_block(zeros[a : a + 8 * AT_ONCE], ones[a : a + 8 * AT_ONCE]) for a in range(0, len(zeros), 8 * AT_ONCE)])
    half, whole = gammas()
    total = zeros + ones
    out = half.take(zeros.astype(np.int64), mode="clip") + half.take(ones.astype(np.int64), mode="clip") - np.log(np.pi) - whole.take(total.astype(np.int64), mode="clip")
    many = np.flatnonzero(total >= COUNTS)
    out[many] = log_gamma(zeros[many] + 0.5) + log_gamma(ones[many] + 0.5) - np.log(np.pi) - log_gamma(total[many] + 1)
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted values, and for each value its place among them."""
    first = np.append(True, values[1:] != values[:-1])[: len(values)]
    return values[first], np.cumsum(first) - 1


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and each end of the texts with its ``depth`` preceding bytes, as one number; and how many each text has.

    The oldest byte is the highest; texts stand between edges.
    """
    edge = bytes([EDGE])
    pad = edge * depth
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # Eight bytes are read at each place, so some stand behind the last text.
    data = b"".join([*(pad + t + edge for t in texts), bytes(7 - depth)])
    if not len(texts):
        return np.zeros(0, np.int64), sizes
    keys = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype("<u8")
    keys >>= np.uint64(8 * (7 - depth))
    inside = np.ones(len(keys), bool)
    ends = np.cumsum(sizes + depth)[:-1] - depth
    inside[(ends[:, None] + np.arange(depth)).ravel()] = False
    return keys.view(np.int64)[inside], sizes


class Level:
    """The nodes of one depth: contexts, and after each the prefixes of the bytes that follow with the counts of their next bit."""

    def __init__(self, depth: int, c: np.ndarray, x: np.ndarray, n: np.ndarray):
        self.depth = depth
        self.pairs = (c.astype(np.int64) << 8) | x
        order = np.argsort(self.pairs, kind="stable")
        self.pairs = self.pairs[order]
        self.contexts, at = runs(self.pairs >> 8)
        byte, number = self.pairs & 0xFF, n[order].astype(np.float64)
        # Prefixes of one length stand in the order of the pairs, so lengths are counted one by one and nothing is sorted but the nodes.
        found = []
        for j in range(8):
            node = (at << 8) | (1 << j) | (byte >> (8 - j))
            first = np.append(True, node[1:] != node[:-1])[: len(node)]
            place = np.cumsum(first) - 1
            size = int(first.sum())
            found.append((node[first], place.astype(np.int32), np.bincount(place, number * ((byte >> (7 - j)) & 1), size), np.bincount(place, number, size)))
        nodes, places, ones, total = zip(*found)
        self.keys = np.concatenate(nodes)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        #: For each bit of each pair of context and byte, its place among the keys.
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        starts = np.cumsum([0, *map(len, nodes)])
        self.place = np.stack([rank[a : a + len(some)][place] for a, some, place in zip(starts, nodes, places)])
        self.ones = np.concatenate(ones)[order]
        self.zeros = np.concatenate(total)[order] - self.ones
        self.weigh(None)

    def below(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the parents add up: their contexts, the prefixes, and counts and logarithm of the mixture."""
        parent = self.contexts[self.keys >> 8] & ((1 << 8 * (self.depth - 1)) - 1)
        return parent, self.keys & 0xFF, np.stack([self.zeros, self.ones, self.weighted])

    def weigh(self, below: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> None:
        """Each node's share of its own estimate in its mixture, and the counts that its unnamed contexts leave."""
        block = log_block(self.zeros, self.ones)
        self.own, self.rest, self.weighted = np.broadcast_to(1.0, len(self.keys)), (self.zeros, self.ones), block
        if below is None or not len(below[0]):
            return
        parent = np.searchsorted(self.contexts, below[0])
        place = np.searchsorted(self.keys, (parent << 8) | below[1])
        zeros, ones, weighted = (np.bincount(place, w, len(self.keys)) for w in below[2])
        self.rest = np.maximum(self.zeros - zeros, 0), np.maximum(self.ones - ones, 0)
        split = np.zeros(len(self.contexts), bool)
        split[parent] = True
        inner = split[self.keys >> 8]
        mixed = np.logaddexp(HALF + block, HALF + weighted + log_block(*self.rest))
        self.own = np.where(inner, np.exp(HALF + block - mixed), 1.0)
        self.weighted = np.where(inner, mixed, block)


class ContextTree:
    """The weighted tree for counts ``n`` of byte ``x`` after context ``c`` of ``d`` bytes.

    With ``top``, the weighed levels of the shortest contexts, the counts are those of the deeper levels only: of a branch,
    the contexts that end alike.
    """

    def __init__(self, depth: int, d: np.ndarray, c: np.ndarray, x: np.ndarray, n: np.ndarray, top: Sequence[Level] = ()):
        self.depth = depth
        own = [Level(k, c[d == k], x[d == k], n[d == k]) for k in range(len(top), depth + 1)]
        self.levels = [*top, *own]
        for k in range(depth - 1, len(top) - 1, -1):
            self.levels[k].weigh(self.levels[k + 1].below())
            self.levels[k + 1].weighted = None  # only parents need it
        self.known = np.zeros(0, np.int64), np.zeros(0)

    def _mixed(self, level: int, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log10 of the chance of bytes after contexts of which ``level`` bytes are the longest node."""
        total = np.zeros(len(byte))
        at = [np.searchsorted(self.levels[k].contexts, context & ((1 << 8 * k) - 1)) for k in range(level + 1)]
        for j in range(8):
            node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            chance = np.full(len(byte), 0.5)
            for k in range(level, -1, -1):
                nodes = self.levels[k]
                key = (at[k] << 8) | node
                place = np.minimum(np.searchsorted(nodes.keys, key), len(nodes.keys) - 1)
                seen = nodes.keys[place] == key
                zeros, ones, own = nodes.zeros[place], nodes.ones[place], nodes.own[place]
                here = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
                if k == level:
                    left = [x[place] for x in nodes.rest]
                    chance = (np.where(bit, left[1], left[0]) + 0.5) / (left[0] + left[1] + 1)
                chance = np.where(seen, own * here + (1 - own) * chance, 0.5)
            total += np.log10(chance)
        return total

    def _computed(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), 8 * np.log10(0.5))
        open_ = np.arange(len(keys))
        for level in range(self.depth, -1, -1):
            nodes = self.levels[level].contexts
            if not len(nodes) or not len(open_):
                continue
            context = (keys[open_] >> 8) & ((1 << 8 * level) - 1)
            at = np.minimum(np.searchsorted(nodes, context), len(nodes) - 1)
            hit = nodes[at] == context
            out[open_[hit]] = self._mixed(level, context[hit], keys[open_[hit]] & 0xFF)
            open_ = open_[~hit]
        return out

    def _learnt(self, rows: list[np.ndarray], byte: np.ndarray) -> np.ndarray:
        """The same for pairs that the tree was learnt from: ``rows`` has their places at each level, -1 where the context is no node."""
        bits = (byte >> np.arange(7, -1, -1)[:, None]) & 1 == 1
        chance, deepest = np.full(bits.shape, 0.5), np.ones(len(byte), bool)
        for nodes, row in zip(self.levels[::-1], rows[::-1]):
            here = np.flatnonzero(row >= 0)
            at, bit, below = nodes.place[:, row[here]], bits[:, here], chance[:, here]
            zeros, ones, own = nodes.zeros[at], nodes.ones[at], nodes.own[at]
            end = deepest[here]
            left = [x[at[:, end]] for x in nodes.rest]
            below[:, end] = (np.where(bit[:, end], left[1], left[0]) + 0.5) / (left[0] + left[1] + 1)
            chance[:, here] = own * (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1) + (1 - own) * below
            deepest[here] = False
        return np.log10(chance).sum(axis=0)

    def _worked_out(self, keys: np.ndarray) -> np.ndarray:
        rows, met = [], np.ones(len(keys), bool)
        for level in self.levels:
            mask = (1 << 8 * level.depth) - 1
            pair = ((keys >> 8 & mask) << 8) | (keys & 0xFF)
            row = np.minimum(np.searchsorted(level.pairs, pair), max(len(level.pairs) - 1, 0))
            found = level.pairs[row] == pair if len(level.pairs) else np.zeros(len(keys), bool)
            rows.append(np.where(found, row, -1))
            none = np.flatnonzero(~found)
            context = keys[none] >> 8 & mask
            if len(level.contexts):
                # A byte that never followed a node's context.
                at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
                met[none[level.contexts[at] == context]] = False
        out = np.empty(len(keys))
        out[met] = self._learnt([row[met] for row in rows], keys[met] & 0xFF)
        out[~met] = self._computed(keys[~met])
        return out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the chance of each byte after its context, both in one number as ``grams`` gives it.

        What is asked for is remembered, unless it is little beside what is known.
        """
        known, logs = self.known
        place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        new = known[place] != keys if len(known) else np.ones(len(keys), bool)
        out = np.where(new, 0.0, logs[place]) if len(known) else np.zeros(len(keys))
        if new.any():
            more, back = np.unique(keys[new], return_inverse=True)
            found = np.concatenate([self._worked_out(more[a : a + AT_ONCE]) for a in range(0, len(more), AT_ONCE)])
            out[new] = found[back]
            if 50 * len(more) > len(known):
                known, logs = np.append(known, more), np.append(logs, found)
                order = np.argsort(known, kind="stable")
                self.known = known[order], logs[order]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the chance of each text and its end."""
        keys, sizes = grams(texts, self.depth)
        return sums(self.log10(keys), sizes)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, of which there is one at least."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)

"""Prediction by partial matching over bytes, with frozen counts.

A context tree of order n keeps, for each context of up to n bytes, the bytes that followed it and how
often. A byte is coded in the longest context that the tree holds. Where the byte was not seen there, an
escape is coded (method C: its weight is the number of distinct bytes seen, plus the count of what the tree
has pruned) and the next shorter context is tried, without the bytes that the longer one has already ruled
out. Below the empty context all bytes left are equally likely. An end symbol (byte 0) closes each text, so the
probabilities of all texts add up to one.
"""

from __future__ import annotations

import numpy as np

END = 0


class Table:
    """From 64-bit keys to their places in a sorted array, by open addressing; -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        waiting = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = waiting[free]
            left = self.slots[slot] != waiting
            waiting, slot = waiting[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and its end: the byte and the ``order`` bytes before it as one number.

    The second array holds where each text's numbers begin, with the total at its end. Bytes before a text are 0.
    """
    gap = b"\0" * max(order, 1)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    key = data[order:].astype(np.uint64)
    for i in range(1, order + 1):
        key |= data[order - i : len(data) - i].astype(np.uint64) << np.uint64(8 * i)
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
    if len(gap) == 1:
        return key[len(gap) - order :][: bounds[-1]], bounds
    starts = np.concatenate(([0], np.cumsum(lengths + len(gap))))[: len(texts)]
    keep = np.zeros(len(key) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + lengths + 1, -1)
    return key[np.cumsum(keep[:-1], dtype=np.int8) > 0], bounds


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class ContextTree:
    """Frozen counts by order: for each order k the grams of k + 1 bytes with their counts, and the contexts of
    k bytes with the totals of all that followed them. Both are sorted. Grams that were pruned count in the totals only;
    whoever prunes a gram must also prune the longer grams that end with it.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.grams, self.contexts, self.log_count, self.log_share = [], [], [], []
        self.weight, self.escape, self.excluded, self.context_of = [], [], [], []
        for k, (grams, n, contexts, totals) in enumerate(levels):
            place = np.searchsorted(contexts, grams >> np.uint64(8)).astype(np.int32)
            distinct = np.bincount(place, minlength=len(contexts))
            excluded = np.zeros(len(contexts))
            if k and len(grams):
                shorter = np.searchsorted(levels[k - 1][0], grams & np.uint64((1 << 8 * k) - 1))
                excluded = np.bincount(place, levels[k - 1][1][shorter], len(contexts))
            self.grams.append(Table(grams))
            self.contexts.append(Table(contexts))
            self.weight.append((totals + distinct).astype(np.float64))
            self.escape.append((totals - np.bincount(place, n, len(contexts)) + distinct).astype(np.float64))
            self.excluded.append(excluded)
            self.context_of.append(place)
            self.log_count.append(np.log2(n.astype(np.float64)))
            self.log_share.append(np.log2(n / self.weight[k][place]))

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> ContextTree:
        """The tree of all grams of ``order + 1`` bytes."""
        levels = []
        for k in range(order + 1):
            grams, n = counted(keys & np.uint64((1 << 8 * (k + 1)) - 1), counts)
            levels.append((grams, n, *counted(grams >> np.uint64(8), n)))
        return cls(levels)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte, given the bytes before it."""
        found = self.grams[self.order].find(keys)
        out = -self.log_share[self.order][found] if len(self.log_share[self.order]) else np.zeros(len(keys))
        left = np.flatnonzero(found < 0)
        if not len(left):
            return out
        rest = keys[left]
        cost, ruled_out = np.zeros(len(left)), np.zeros(len(left))
        for k in range(self.order, -1, -1):
            if k < self.order:
                rest = rest & np.uint64((1 << 8 * (k + 1)) - 1)
                found = self.grams[k].find(rest)
                hit = found >= 0
                if hit.any():
                    at = found[hit]
                    weight = self.weight[k][self.context_of[k][at]] - ruled_out[hit]
                    out[left[hit]] = cost[hit] + np.log2(weight) - self.log_count[k][at]
                miss = ~hit
                left, rest, cost, ruled_out = left[miss], rest[miss], cost[miss], ruled_out[miss]
                if not len(left):
                    return out
            context = self.contexts[k].find(rest >> np.uint64(8))
            known = context >= 0
            at = context[known]
            cost[known] += np.log2((self.weight[k][at] - ruled_out[known]) / self.escape[k][at])
            ruled_out[:] = 0
            ruled_out[known] = self.excluded[k][at]
        out[left] = cost + np.log2(256 - len(self.grams[0].keys)) if len(self.grams[0].keys) < 256 else cost
        return out


def text_bits(tree: ContextTree, texts: list[bytes]) -> np.ndarray:
    """Code length of each whole text with its end."""
    keys, bounds = grams_of(texts, tree.order)
    return np.add.reduceat(tree.bits(keys), bounds[:-1]) if len(texts) else np.zeros(0)


def bits_by_tree(trees: list[ContextTree], texts: list[bytes]) -> np.ndarray:
    """``text_bits`` of each text (rows) under each of some trees of one order; each distinct gram is looked up once."""
    keys, bounds = grams_of(texts, trees[0].order)
    distinct, place = np.unique(keys, return_inverse=True)
    if not len(texts):
        return np.zeros((0, len(trees)))
    return np.stack([np.add.reduceat(tree.bits(distinct)[place], bounds[:-1]) for tree in trees], 1)


def adaptive_bits(text: bytes, order: int) -> float:
    """Code length of a text under counts learned from its own earlier bytes alone, with the same escapes.

    A loop over bytes in Python: for reports on single texts, not for a corpus.
    """
    tree: dict[bytes, dict[int, int]] = {}
    history, total = b"\0" * order, 0.0
    for byte in (*text, END):
        ruled_out: set[int] = set()
        for k in range(order, -1, -1):
            seen = tree.get(history[order - k :], {})
            weight = sum(n for b, n in seen.items() if b not in ruled_out) + len(seen)
            if byte in seen:
                total += np.log2(weight / seen[byte])
                break
            if seen:
                total += np.log2(weight / len(seen))
                ruled_out |= seen.keys()
        else:
            total += np.log2(256 - len(ruled_out))
        for k in range(order + 1):
            seen = tree.setdefault(history[order - k :], {})
            seen[byte] = seen.get(byte, 0) + 1
        history = (history + bytes([byte]))[1:] if order else b""
    return float(total)

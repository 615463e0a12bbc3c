"""Re-Pair grammar compression of id sequences, one grammar a segment, in numpy.

Rounds replace the most frequent adjacent pairs by new symbols, left to right and
without overlap, until no pair occurs ``LEAST`` times. Pairs never cross a
document's end, so each document is a range of symbols. A rule keeps its two parts and
the length it expands to; with these any document, and any place in it, is found
without decoding what comes before.

A segment's bytes, little-endian: magic, first new symbol, rules, documents, symbols
(uint32 each); rules as uint32 pairs; their expansion lengths, uint32; the documents'
first symbols and, last, the count of symbols, uint32; the symbols, uint16 or uint32.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x31525047
#: Pairs replaced in one round, times a pair has to occur, bits of the count table's slots.
PAIRS, LEAST, SLOTS = 2048, 16, 18


def _alternate(hit: np.ndarray) -> np.ndarray:
    """Of runs of adjacent hits every other one, from the left."""
    at = np.flatnonzero(hit)
    if len(at) < 2:
        return at
    run = np.concatenate([[True], np.diff(at) > 1])
    first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


def _frequent(pair: np.ndarray, slot: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Pairs that occur ``LEAST`` times at the ``inner`` places, one a slot at most.

    The slots with most pairs each yield the pair that fills most of them; where that
    finds none, all pairs are counted one by one."""
    counts = np.bincount(slot[inner], minlength=1 << SLOTS)
    often = np.flatnonzero(counts >= LEAST)
    often = often[np.argsort(-counts[often], kind="stable")[:PAIRS]]
    rank = np.zeros(1 << SLOTS, bool)
    rank[often] = True
    for some in (rank[slot] & inner, inner):
        found, times = np.unique(pair[some], return_counts=True)
        found, times = found[times >= LEAST], times[times >= LEAST]
        if len(found) or not len(often):
            break
    of = _slots(found)
    order = np.lexsort((found, -times, of))
    return found[order[np.diff(of[order], prepend=-1) > 0]]


def _slots(pair: np.ndarray) -> np.ndarray:
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """``ids``: the documents' ids one after another; ``ends``: where each one ends."""
    symbols = ids.astype(np.uint32)
    starts = np.concatenate([[0], ends]).astype(np.int64)
    first = int(symbols.max()) + 1 if len(symbols) else 1
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    while len(symbols) > 1:
        pair = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        inner = np.ones(len(pair), bool)
        edge = starts[1:-1] - 1  # a document's last symbol has no partner
        inner[edge[(edge >= 0) & (edge < len(pair))]] = False
        slot = _slots(pair)
        chosen = _frequent(pair, slot, inner)
        if not len(chosen):
            break
        rank = np.full(1 << SLOTS, -1, np.int32)
        rank[_slots(chosen)] = np.arange(len(chosen))
        hit = (rank[slot] >= 0) & inner
        hit[hit] = chosen[rank[slot[hit]]] == pair[hit]
        at = _alternate(hit)
        name = rank[slot[at]]
        parts = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        symbols[at] = (name + first + len(rules)).astype(np.uint32)
        known = np.concatenate([np.ones(first, np.int64), lengths])
        lengths = np.concatenate([lengths, known[parts].sum(axis=1)])
        rules = np.concatenate([rules, parts])
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        symbols, starts = symbols[keep], kept[starts]
    width = np.uint16 if first + len(rules) <= 1 << 16 else np.uint32
    head = np.array([MAGIC, first, len(rules), len(ends), len(symbols)], "<u4")
    return b"".join(x.tobytes() for x in (head, rules.astype("<u4"), lengths.astype("<u4"), starts.astype("<u4"), symbols.astype(np.dtype(width).newbyteorder("<"))))


class Segment:
    """Reads the bytes of ``compress``."""

    def __init__(self, data: bytes):
        magic, self.first, rules, docs, count = (int(x) for x in np.frombuffer(data, "<u4", 5))
        if magic != MAGIC:
            raise ValueError("not a segment of grammar-coded ids")
        at = 20
        self.rules = np.frombuffer(data, "<u4", 2 * rules, at).reshape(-1, 2)
        at += 8 * rules
        self.lengths = np.frombuffer(data, "<u4", rules, at)
        at += 4 * rules
        self.starts = np.frombuffer(data, "<u4", docs + 1, at).astype(np.int64)
        at += 4 * (docs + 1)
        self.symbols = np.frombuffer(data, "<u2" if self.first + rules <= 1 << 16 else "<u4", count, at)
        # every rule's expansion, one after another; parts always come before the rule
        self.size = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        self.place = np.concatenate([np.arange(self.first), self.first + np.cumsum(self.lengths) - self.lengths]).astype(np.int64)
        self.flat = np.concatenate([np.arange(self.first, dtype=np.uint32), np.zeros(int(self.lengths.sum()), np.uint32)])
        for k, (a, b) in enumerate(self.rules.tolist()):
            to, cut = self.place[self.first + k], self.size[a]
            self.flat[to : to + cut] = self.flat[self.place[a] : self.place[a] + cut]
            self.flat[to + cut : to + cut + self.size[b]] = self.flat[self.place[b] : self.place[b] + self.size[b]]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, np.uint32)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.place[symbols] - (ends - size), size)]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document ends."""
        sizes = np.concatenate([[0], np.cumsum(self.size[self.symbols])])
        return self._expand(self.symbols), sizes[self.starts[1:]]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start:stop of document k; only the symbols that cover them are expanded."""
        own = self.symbols[self.starts[k] : self.starts[k + 1]]
        ends = np.cumsum(self.size[own])
        stop = int(ends[-1]) if len(ends) and stop is None else min(stop or 0, int(ends[-1]) if len(ends) else 0)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(own[a:b])[start - before : stop - before]

"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters within e edits of a document's passage shares at least
m - q + 1 - q e of its q-grams with it, on diagonals (place in the document minus place
in the item) that differ by e at most. Hits are counted in diagonal bands of width
2 (e + 1) that overlap by half; a band with enough hits is aligned with the item, in
that band, with free ends in the document, and counts if e edits suffice. The edit budget
e is ``RATE`` of the item; q is the largest of ``SIZES`` for which the bound is 1 or more, so
every item is matched as a whole under one rule, from a single character on.

Characters are compared in lower case, any white space as a space. The index of the items is
sent to all tasks; it is built in slices of about ``SLICE`` characters (or of one item, where
that is longer), one pass over the documents a slice.

Defined results: null texts and null or empty items match nothing; repeated rows and items
each match on their own; empty tables give an empty result; other columns are ignored. Spans
are code points of the text, end exclusive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import OWN, map_texts, ranges

#: Lengths of q-grams, edits by characters, characters in a slice of the index.
SIZES, RATE, SLICE = (8, 4, 2, 1), 0.1, 4_000_000
#: Candidates aligned at once, and cells of a row of the alignment for all of them.
TOGETHER, CELLS = 64, 1 << 19
_BLOOM = 20
_folded: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> its lower case if that is one code point; white space -> space."""
    global _folded
    if _folded is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isspace():
                table[k] = 32
            elif len(low := c.lower()) == 1:
                table[k] = ord(low)
        _folded = table
    return _folded


def points(text: str) -> np.ndarray:
    return _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on, for a q of ``SIZES``."""
    h = chars.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if step == q:
            break
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The q-grams of some items, sorted by hash, with their items and places."""

    def __init__(self, q: int, rows: list[tuple[int, np.ndarray]]):
        self.q = q
        found = [(item, grams(chars, q)) for item, chars in rows]
        hashes = np.concatenate([np.zeros(0, np.uint64), *[g for _, g in found]])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.array([k for k, _ in found], np.int64), [len(g) for _, g in found])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for _, g in found]])[order]
        self.bloom = np.zeros(1 << _BLOOM, bool)
        self.bloom[(self.hashes >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, row here) of every shared q-gram."""
        h = grams(flat, self.q)
        at = np.flatnonzero(self.bloom[(h >> np.uint64(64 - _BLOOM)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, h[at], "left")
        hit = (lo < len(self.hashes)) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h[at])
        at, lo = at[hit], lo[hit]
        many = np.searchsorted(self.hashes, h[at], "right") - lo
        to = np.cumsum(many)
        row = np.arange(to[-1] if len(to) else 0) + np.repeat(lo - (to - many), many)
        return np.repeat(at, many), row


class Index:
    """Benchmark items, their edit budgets, the hits they need, and their q-grams by q."""

    def __init__(self, items: list[tuple]):
        known = [(item, chars) for item, text in items if len(chars := points(text or ""))]
        self.ids, self.chars = [k for k, _ in known], [c for _, c in known]
        self.size = np.array([len(c) for c in self.chars], np.int64)
        self.edits = np.floor(self.size * RATE).astype(np.int64)
        bound = np.stack([self.size - q + 1 - q * self.edits for q in SIZES]) if known else np.zeros((len(SIZES), 0), np.int64)
        kind = (bound > 0).argmax(axis=0)
        self.needs = bound[kind, np.arange(len(known))]
        self.longest = int(self.size.max()) if known else 0
        self.grams = [Grams(q, [(x, self.chars[x]) for x in np.flatnonzero(kind == k).tolist()]) for k, q in enumerate(SIZES) if (kind == k).any()]


def align(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, width: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each item in its text, and where the best passage ends.

    Cells with text place minus item place in [low, low + width) count. The passage starts
    anywhere, or at the text's first character if ``anchored``."""
    n, rows = len(items), max(map(len, items))
    far = 1 << 20
    own = np.full((n, rows), 0, np.uint32)
    for k, x in enumerate(items):
        own[k, : len(x)] = x
    pad = rows + width + 1
    wide = max(map(len, texts)) + 2 * pad + int(np.abs(low).max())
    field = np.full((n, wide), 0xFFFFFFFF, np.uint32)
    for k, x in enumerate(texts):
        field[k, pad : pad + len(x)] = x
    length = np.array([len(x) for x in texts])[:, None]
    size = np.array([len(x) for x in items])
    shift = np.arange(width)
    at = low[:, None] + shift  # text place before the first character
    now = np.where((at >= 0) & (at <= length), at if anchored else 0, far).astype(np.int64)
    best, end = np.full(n, far, np.int64), np.zeros(n, np.int64)
    line = np.arange(n)
    for i in range(rows):
        j = at + i
        cost = np.take_along_axis(field, np.clip(j + pad, 0, wide - 1), axis=1) != own[:, i : i + 1]
        new = np.where((j >= 0) & (j < length), now + cost, far)
        up = np.full_like(now, far)
        up[:, :-1] = now[:, 1:] + 1
        new = np.minimum(new, up)
        new[(j + 1 < 0) | (j + 1 > length)] = far
        now = np.minimum(np.minimum.accumulate(new - shift, axis=1) + shift, far)
        now[(j + 1 < 0) | (j + 1 > length)] = far
        if (done := size == i + 1).any():
            k = now[done].argmin(axis=1)
            best[done], end[done] = now[line[done], k], j[line[done], k] + 1
    return best, end


def _bands(index: Index, some: Grams, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, band, text) with enough hits; bands of an item with e edits start at
    diagonals that are multiples of e + 1, counted from minus the longest item's length."""
    place, row = some.hits(flat)
    item = some.item[row]
    band = (place - some.place[row] + index.longest) // (index.edits[item] + 1)
    text = np.searchsorted(ends, place, "right")
    # each hit counts in its band of the grid and, by the overlap, in the one before
    key = (item << 40) + band
    rough = ((np.concatenate([key, key - 1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    count = np.bincount(rough, minlength=1 << 20)
    maybe = count[rough] >= np.tile(index.needs[item], 2)
    keys, owner = np.concatenate([key, key - 1])[maybe], np.tile(text, 2)[maybe]
    if not len(keys):
        return keys, keys, keys
    pairs, inverse = np.unique(np.stack([keys, owner]), axis=1, return_inverse=True)
    pairs = pairs[:, np.bincount(inverse.ravel(), minlength=pairs.shape[1]) >= index.needs[pairs[0] >> 40]]
    return pairs[0] >> 40, pairs[0] & ((1 << 40) - 1), pairs[1]


def find(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the best passage for each matching pair."""
    whole = [points(t or "") for t in texts]
    ends = np.cumsum([len(w) + 1 for w in whole])  # a gap after each text
    begins = ends - [len(w) + 1 for w in whole]
    flat = np.concatenate([np.zeros(0, np.uint32), *[np.concatenate([w, [0]]).astype(np.uint32) for w in whole]])
    found = [_bands(index, some, flat, ends) for some in index.grams]
    item, band, text = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.argsort(index.size[item], kind="stable")
    item, band, text = item[order], band[order], text[order]
    out: dict = {}
    for a, b in ranges((CELLS // TOGETHER + index.size[item]).tolist(), CELLS):
        _aligned(index, whole, begins, item[a:b], band[a:b], text[a:b], out)
    return [(t, i, *v) for (t, i), v in out.items()]


def _aligned(index: Index, whole: list[np.ndarray], begins: np.ndarray, item: np.ndarray, band: np.ndarray, text: np.ndarray, out: dict) -> None:
    """Puts the best passage of each band that holds one into ``out``."""
    e = index.edits[item]
    start = band * (e + 1) - index.longest - begins[text]  # least diagonal of the band, in the text
    wide = int((4 * e).max()) + 3
    cut = np.maximum(0, start - e)
    own = [index.chars[k] for k in item]
    field = [whole[t][c : c + len(o) + wide + 1] for t, c, o in zip(text, cut, own, strict=True)]
    near = []
    for k, (o, f) in enumerate(zip(own, field, strict=True)):  # no edits: nothing to align
        at = f.tobytes().decode("utf-32-le", "surrogatepass").find(o.tobytes().decode("utf-32-le", "surrogatepass"))
        if at >= 0:
            pair, found = (int(text[k]), index.ids[item[k]]), (0, int(cut[k]) + at, int(cut[k]) + at + len(o))
            out[pair] = min(out.get(pair, found), found)
        elif e[k]:
            near.append(k)
    if not near:
        return
    item, text, e, start, cut = item[near], text[near], e[near], start[near], cut[near]
    own, field = [own[k] for k in near], [field[k] for k in near]
    edits, stop = align(own, field, start - e - cut, wide)
    if not (good := np.flatnonzero(edits <= e)).size:
        return
    back = [field[k][: stop[k]][::-1] for k in good]
    _, length = align([own[k][::-1] for k in good], back, -e[good] - 1, int(2 * (e.max() + 1)) + 1, anchored=True)
    for k, n in zip(good, length, strict=True):
        found = (int(edits[k]), int(cut[k] + stop[k] - n), int(cut[k] + stop[k]))
        pair = int(text[k]), index.ids[item[k]]
        out[pair] = min(out.get(pair, found), found)


def _slices(items: DataFrame) -> list[DataFrame]:
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = int(-(-total // (SLICE // 2))) if total > SLICE else 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)] if count > 1 else [items]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for each pair of a document (doc_id, text) and a
    benchmark item (item_id, text) that it holds within the item's edit budget."""
    return _matches(docs, ["doc_id"], items)


def _matches(docs: DataFrame, keep: list[str], items: DataFrame) -> DataFrame:
    items = items.select("item_id", "text").where("text is not null")
    kind = items.schema["item_id"].dataType.simpleString()
    found = []
    for part in _slices(items):
        rows = [tuple(r) for r in part.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Index(rows))
        arrow = part.limit(0).toArrow().schema.field("item_id").type

        def work(texts: list[str | None], shared=shared, arrow=arrow) -> tuple:
            got = sorted(find(shared.value, texts), key=lambda x: (x[0], str(x[1])))
            return [x[0] for x in got], [pa.array([x[k] for x in got], t) for k, t in ((1, arrow), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]

        found.append(map_texts(docs, keep, f"item_id {kind}, edits int, start int, end int", work))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    marked = docs.withColumn(OWN, F.xxhash64("text"))
    hit = _matches(marked, ["doc_id", OWN], items).select(F.col("doc_id").alias("_id"), F.col(OWN).alias("_leak")).distinct()
    same = marked["doc_id"].eqNullSafe(hit["_id"]) & (marked[OWN] == hit["_leak"])
    return marked.join(hit, same, "left_anti").drop(OWN)

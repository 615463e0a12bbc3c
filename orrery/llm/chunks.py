"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 characters proposes cuts where it falls into a set
of density 1 / ``SPACING``; a proposal less than ``LEAST`` characters behind a cut is left out. So
cuts depend on nearby text, and fall together again soon after an insertion. Chunks are
compared by a 128-bit digest; a chunk that another document has as well repeats. Repeating
chunks side by side form regions, and regions of ``REGION`` characters or more are reported.

The document with the smallest doc_id that holds a chunk keeps it; elsewhere the chunk, and
the region of such chunks, is removable. Spans are code points, end exclusive.

A digest that many rows share is met by a broadcast instead of a shuffle: digests of more
than 1 / ``HOT`` of all chunks, of which there are fewer than ``HOT``.

Defined results: null and empty texts have no chunk; each text of a doc_id has regions of its
own, which ``text_hash`` (its XXH64) names, and rows that repeat both are one; rows that share a
doc_id are one document when it comes to what other documents hold (null is an id of its
own, and the smallest); chunks that repeat only inside one document do not count; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import map_texts, saved

#: Mean distance of proposed cuts, least distance of cuts, characters of a region.
SPACING, LEAST, REGION = 20, 12, 100
#: Digests that a broadcast may hold.
HOT = 50_000
_ROLL = 16
_GEAR = np.random.default_rng(2).integers(0, 1 << 63, 4096, np.uint64)


def cuts(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks start in the code points of texts that start at ``begins``."""
    h = _GEAR[(flat ^ (flat >> np.uint32(12))) & np.uint32(4095)]
    for step in (1, 2, 4, 8):
        rolled = h.copy()
        rolled[step:] += h[:-step] << np.uint64(step)
        h = rolled
    hit = np.flatnonzero(h >> np.uint64(40) < np.uint64((1 << 24) // SPACING)) + 1
    text = np.searchsorted(begins, hit - 1, "right") - 1
    hit = hit[hit - begins[text] >= _ROLL]  # the hash looks at this text alone
    kept, last = [], -LEAST
    for place in hit.tolist():
        if place - last >= LEAST:
            kept.append(place)
            last = place
    hit = np.array(kept, np.int64)
    return np.union1d(hit[hit < len(flat)], begins[begins < len(flat)])


def chunk_texts(texts: list[str | None]) -> tuple[np.ndarray, list]:
    """(text of each chunk, [two halves of its digest, start and length in one number])."""
    whole = "".join(t or "" for t in texts)
    size = np.array([len(t or "") for t in texts], np.int64)
    begins = np.cumsum(size) - size
    if not whole:
        none = np.zeros(0, np.int64)
        return none, [none, none, none]
    flat = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = cuts(flat, begins[size > 0])
    end = np.append(start[1:], len(flat))
    raw = memoryview(flat).cast("B")
    digest = xxhash.xxh3_128_digest
    got = b"".join(digest(raw[a:b]) for a, b in zip((4 * start).tolist(), (4 * end).tolist(), strict=True))
    halves = np.frombuffer(got, np.int64).reshape(-1, 2)
    full = np.flatnonzero(size > 0)
    text = full[np.searchsorted(begins[full], start, "right") - 1]
    return text, [halves[:, 0].copy(), halves[:, 1].copy(), (start - begins[text]) << 32 | (end - start)]


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, d0, d1, span) of every chunk: what is shuffled is five numbers."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_texts(kept, ["doc_id", "text_hash"], "d0 long, d1 long, span long", chunk_texts)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, chunks, first_doc, keepers, removable): the repeating
    regions. ``keepers`` are the documents that keep its chunks, ``first_doc`` is the least."""
    chunks, digest = saved(chunked(docs), "chunks"), ["d0", "d1"]
    shared = chunks.groupBy(*digest).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("none"), F.count(F.lit(1)).alias("n")
    )
    several = (F.col("first") < F.col("last")) | (F.col("none") & F.col("first").isNotNull())
    shared = saved(shared.where(several).select(*digest, F.when(~F.col("none"), F.col("first")).alias("first"), "n"), "shared")
    often = F.col("n") > max(1000, chunks.count() // HOT)
    hot = F.broadcast(shared.where(often).drop("n"))  # fewer than HOT rows of a few bytes
    met = chunks.join(hot, digest).unionByName(chunks.join(hot, digest, "left_anti").join(shared.where(~often).drop("n"), digest))
    start = F.shiftright("span", 32)
    met = met.select(
        "doc_id", "text_hash", "first", start.alias("start"), (start + F.col("span").bitwiseAND(F.lit((1 << 32) - 1))).alias("end"), (~F.col("first").eqNullSafe(F.col("doc_id"))).alias("removable")
    )
    # chunks stand side by side where one starts at another's end
    run = Window.partitionBy("doc_id", "text_hash", "removable").orderBy("start")
    apart = met.withColumn("apart", (F.col("start") > F.coalesce(F.lag("end").over(run), F.lit(-1))).cast("long"))
    island = apart.withColumn("island", F.sum("apart").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    keeper = F.struct(F.col("first").isNotNull().alias("known"), "first")  # null is the smallest
    regions = island.groupBy("doc_id", "text_hash", "removable", "island").agg(
        F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.count_distinct("start").alias("chunks"), F.array_sort(F.collect_set(keeper)).alias("keepers")
    )
    long = regions.where(F.col("end") - F.col("start") >= REGION)
    return long.select("doc_id", "text_hash", "start", "end", "chunks", F.col("keepers")[0]["first"].alias("first_doc"), F.transform("keepers", lambda x: x["first"]).alias("keepers"), "removable")

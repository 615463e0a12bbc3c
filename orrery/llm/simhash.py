"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in two
bits at most, then for one of the cyclic pairs of segments (A, B), (B, C), (C, A) the
first segment is equal and the second differs in one bit at most. So each fingerprint
is stored under (pair, first segment, index of the Golay codeword nearest to the second)
and looked up under the indices of all words within one bit of its second segment. The
join on these keys is verified by counting differing bits, and links are closed into
components. Documents with one fingerprint are one node throughout, so groups of
copies never form pairs.

Defined results: a null or blank text has fingerprint zero and links like any other;
repeated rows each get a row; a component without any non-null id has a null
component_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import golay
from orrery.llm.common import OWN, map_texts, saved
from orrery.llm.components import components

SEED = 42
#: (lowest bit, width) of the segments; all fit into a Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _lanes() -> np.ndarray:
    """For each byte value a word with one 8-bit lane for each of its bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.reshape(256, 8).view(np.uint64)[:, 0].copy()


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    """XXH64 of the word shingles, repeats included; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(x), SEED) for x in zip(*(words[k:] for k in range(size)))]


_LANES = _lanes()


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return np.uint64(0)
    spread, most = _LANES[hashes.view(np.uint8)].reshape(-1, 8), 255
    sums = np.add.reduceat(spread, np.arange(0, len(spread), most), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(texts: list[str | None], size: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text."""
    return np.array([fingerprint(np.array(shingle_hashes(t, size), np.uint64)) for t in texts], np.uint64)


def with_fingerprint(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long."""

    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_texts(cut, ["doc_id", "text_hash"], "fp long", lambda texts: [fingerprints(texts, size).view(np.int64)])


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp, stored) for distinct fingerprints: 3 stored keys and 3 to 18 looked up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 20_000):
                fp = pdf["fp"].to_numpy(np.int64)[at : at + 20_000]
                parts = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
                for pair in range(3):
                    exact, fuzzy, width = parts[pair], parts[(pair + 1) % 3], SEGMENTS[(pair + 1) % 3][1]
                    base = (pair << 22 | exact) << golay.DIMENSION
                    rows, index = golay.nearby(fuzzy, width)
                    yield pd.DataFrame({"key": base | golay.decode(fuzzy), "fp": fp, "stored": True})
                    yield pd.DataFrame({"key": base[rows] | index, "fp": fp[rows], "stored": False})

    return fps.mapInPandas(run, "key long, fp long, stored boolean")


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in ``most`` <= 2 bits."""
    keys = saved(_keys(fps), "golay")
    stored = keys.where("stored").select("key", F.col("fp").alias("b"))
    looked = keys.where("not stored").select("key", F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return saved(looked.join(stored, (looked["key"] == stored["key"]) & near).select("a", "b").distinct(), "links", keys)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id, ...) for the distinct fingerprints of (doc_id, text_hash, fp).

    keep_id and keep_hash name the one document that stands for the component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash"))
    nodes = saved(prints.groupBy("fp").agg(first.alias("first")), "fps")
    found = links(nodes.select("fp"))
    roots = components(found)
    tagged = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tagged = saved(tagged, "tagged", nodes, found)
    heads = tagged.groupBy("root").agg(F.min("first").alias("head"))
    return tagged.select("fp", "root").join(heads, "root").select(
        "fp", F.col("head.doc_id").alias("component_id"), F.col("head.doc_id").alias("keep_id"), F.col("head.text_hash").alias("keep_hash")
    )


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text)."""
    prints = saved(with_fingerprint(docs, size), "prints")
    found = saved(classes(prints).select("fp", "component_id"), "classes")
    return prints.join(found, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id."""
    prints = saved(with_fingerprint(docs, size), "prints")
    heads = saved(classes(prints).select("keep_id", "keep_hash").distinct(), "heads")
    marked = docs.withColumn(OWN, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(heads["keep_id"]) & (marked[OWN] == heads["keep_hash"])
    return marked.join(heads, same, "left_semi").dropDuplicates(["doc_id", OWN]).drop(OWN)

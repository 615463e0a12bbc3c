"""Near copies by the similarity of word shingles: the rule of the pipeline's stage.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; links are closed into components. Documents with one text are one
node throughout. The result is that of a comparison of all pairs, in two rounds.

The first finds most links cheaply. Candidates come from SimHash and Golay keys (``simhash``) and
from ``BANDS`` keys of ``ROWS`` minimum hashes; in each key's group all texts are compared with
the smallest and the largest node, so groups of copies form no pairs.

The second finds every link that is left between two components of the first, in three steps
of which the first two look at single texts and count, so that they make no pairs. With all shingles in
one order, two texts at 0.8 have k + 1 shingles in common among the first fifth and k more of each
(``prefix``): texts that do not share as many there with texts of other components have no
such link. Shingles that are frequent in a bounded sample come last in that order, as any order
gives the same links. Of the texts that are left all shingles are taken: four fifths of them have to be
held by texts of other components. What is left then, texts that others cover almost
whole, is ordered again, by how many of them hold a shingle, and those of different components that share
one of their first fifth are compared, unless their sizes or the shingle's places rule a link
out. Texts of many components that are covered by each other and miss the threshold narrowly are all
compared: that part is quadratic in their number.

Each comparison is exact, over 64-bit hashes of the shingles.

Defined results: null and blank texts have no shingle and are copies of each other; a
text of under five words is one shingle; repeated rows give one row; a component without
any non-null id keeps one of its documents; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.common import OWN, discard, map_texts, saved
from orrery.llm.components import components

#: Words in a shingle; the least similarity, as a fraction.
SIZE, LEAST = 5, (4, 5)
#: Keys of a text, and minimum hashes in each.
BANDS, ROWS = 20, 5
#: Texts in the sample that shows which shingles are frequent, and shingles kept of it.
SAMPLE, FREQUENT = 20_000, 100_000
#: One in so many of a text's shingles is looked at beyond its first fifth.
MORE = 20
_RNG = np.random.default_rng(42)
_ADD, _TIMES = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes."""
    return np.unique(np.array(simhash.shingle_hashes(text, SIZE), np.uint64))


def keys(own: np.ndarray) -> np.ndarray:
    """The keys of a text's shingles, one a band; without any, one key of its own kind."""
    if not len(own):
        return np.zeros(1, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 512):
        part = (own[at : at + 512, None] ^ _ADD) * _TIMES
        least = np.minimum(least, (part ^ part >> np.uint64(32)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def prefix(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles of a text, of which a near copy has 1 + size // MORE (of the smaller
    text's size) among its own first: those of ``last`` (sorted) come behind the others, in ``last``'s ranks."""
    if not len(own):
        return own
    if len(last):
        at = np.minimum(np.searchsorted(last["hash"], own), len(last) - 1)
        rank = np.where(last["hash"][at] == own, last["rank"][at], 0)
        own = own[np.argsort(rank, kind="stable")]
    return own[: len(own) - -(-len(own) * LEAST[0] // LEAST[1]) + 1 + len(own) // MORE]


def frequent(docs: DataFrame) -> np.ndarray:
    """(hash, rank) by hash: shingles of several sampled texts, ranked by how many have them."""
    texts = docs.select("text").withColumn("node", F.xxhash64("text"))
    few = max(1, -(-texts.count() // SAMPLE))
    some = texts.where(F.pmod("node", F.lit(few)) == 0).dropDuplicates(["node"])
    own = map_texts(some, ["node"], "own array<long>", lambda texts: _lists([shingles(t) for t in texts]))
    often = own.select(F.explode("own").alias("shingle")).groupBy("shingle").count().where("count > 2")
    rows = often.orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    held = np.zeros(len(rows), [("hash", np.uint64), ("rank", np.int64)])
    held["hash"], held["rank"] = rows.column("shingle").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    return np.sort(held, order="hash")


def _signed(last: np.ndarray):
    def run(texts: list[str | None]) -> list[pa.Array]:
        """The fingerprint, the keys, the number of shingles and the first ones of each text."""
        own = [shingles(t) for t in texts]
        fp = np.array([simhash.fingerprint(x) for x in own], np.uint64).view(np.int64)
        sizes = pa.array([len(x) for x in own], pa.int32())
        return [pa.array(fp), *_lists([keys(x) for x in own]), sizes, *_lists([prefix(x, last) for x in own])]

    return run


def _lists(found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes: each with the least of its fingerprint, those with each
    other where fingerprints are near, and each with the ends of its keys' groups."""
    least = saved(prints.groupBy("fp").agg(F.min("text_hash").alias("low")), "fps")
    same = prints.select("fp", "text_hash").distinct().join(least, "fp").select(F.col("text_hash").alias("node"), F.col("low").alias("end"))
    near = simhash.links(least.select("fp"))
    ends = near.join(least.select(F.col("fp").alias("a"), F.col("low").alias("node")), "a").join(least.select(F.col("fp").alias("b"), F.col("low").alias("end")), "b")
    own = saved(prints.select(F.col("text_hash").alias("node"), F.explode("keys").alias("key")).distinct(), "keys")
    held = own.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = own.join(held, "key").select("node", F.explode(F.array("low", "high")).alias("end"))
    pairs = met.unionByName(same).unionByName(ends.select("node", "end")).where("node <> end")
    return saved(pairs.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct(), "pairs", own, least)


def sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, own): the shingles of the texts ``asked`` (node); ``nodes`` (text_hash, first) name a row each."""
    named = nodes.join(asked, nodes["text_hash"] == asked["node"], "left_semi").select("text_hash", "first.doc_id")
    marked = docs.select("doc_id", F.xxhash64("text").alias(OWN), "text")
    same = marked["doc_id"].eqNullSafe(named["doc_id"]) & (marked[OWN] == named["text_hash"])
    texts = marked.join(named, same, "left_semi").select(F.col(OWN).alias("node"), "text").dropDuplicates(["node"])
    return saved(map_texts(texts, ["node"], "own array<long>", lambda texts: _lists([shingles(t) for t in texts])), "sets")


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose similarity is high enough; ``sets`` has the shingles of their texts."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    counted = met.select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("all"))
    return saved(counted.where(F.col("both") * LEAST[1] >= F.col("all") * LEAST[0]).select("a", "b"), "links", sets)


def needed(size: Column) -> Column:
    """The least overlap of a near copy with a set of ``size``, which is its least size too."""
    return F.ceil(size * LEAST[0] / LEAST[1])


def shared(own: DataFrame) -> DataFrame:
    """The rows (node, root, size, shingle) whose shingle texts of several components have."""
    group = Window.partitionBy("shingle")
    ends = {"_low": F.min("root").over(group), "_high": F.max("root").over(group)}
    return own.withColumns(ends).where("_low < _high").drop("_low", "_high")


def covered(held: DataFrame, least: Column) -> DataFrame:
    """(node, root, size) of the texts that have ``least`` of the rows or more."""
    return held.groupBy("node", "root", "size").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= least).drop("held")


def missed(rows: DataFrame, left: DataFrame) -> DataFrame:
    """Pairs (a, b) of the texts ``left`` of different components that may be linked: those that share
    one of their first shingles, at places that leave enough of both behind it. ``rows`` has the
    shingles that texts of several components share; a text's others come before them."""
    own = rows.join(left.select("node"), "node", "left_semi")
    own = own.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("shingle")))
    of_text = Window.partitionBy("node")
    back = F.count(F.lit(1)).over(of_text) - F.row_number().over(of_text.orderBy("often", "shingle"))
    own = own.withColumn("rest", back + 1).where(F.col("rest") >= needed(F.col("size")))
    own = saved(own.select("shingle", "node", "root", "size", "rest"), "firsts")
    side = lambda x: own.select("shingle", *(F.col(c).alias(x + c) for c in ("node", "root", "size", "rest")))
    enough = F.least("arest", "brest") * (LEAST[0] + LEAST[1]) >= (F.col("asize") + F.col("bsize")) * LEAST[0]
    met = side("a").join(side("b").hint("merge"), "shingle").where((F.col("aroot") < F.col("broot")) & enough)
    return saved(met.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct(), "pairs", own)


def missed_links(docs: DataFrame, nodes: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The links (a, b) between texts of different components; ``roots`` (node, root) has all texts."""
    first = prints.select(F.col("text_hash").alias("node"), "size", "first").dropDuplicates(["node"]).join(roots.hint("merge"), "node")
    held = shared(first.select("node", "root", "size", F.explode("first").alias("shingle")))
    left = saved(covered(held, 1 + F.floor(needed(F.col("size")) / MORE)), "left")
    own = sets(docs, nodes, left)
    every = own.join(left.hint("merge"), "node").select("node", "root", "size", F.explode("own").alias("shingle"))
    rows = saved(shared(every), "rows", left)
    left = saved(covered(rows, needed(F.col("size"))), "left")
    pairs = missed(rows, left)
    found = links(pairs, own)
    for spent in (rows, left, pairs):
        discard(spent)
    return found


def classes(docs: DataFrame) -> DataFrame:
    """(text_hash, keep_id, keep_hash): the one document that stands for each text's component."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    made = "fp long, keys array<long>, size int, first array<long>"
    prints = saved(map_texts(cut, ["doc_id", "text_hash"], made, _signed(frequent(docs))), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash"))
    nodes = saved(prints.groupBy("text_hash").agg(first.alias("first")), "nodes")
    pairs = candidates(prints)
    found = links(pairs, sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    tagged = nodes.join(components(found).withColumnRenamed("node", "text_hash"), "text_hash", "left")
    tagged = saved(tagged.withColumn("root", F.coalesce("root", "text_hash")), "tagged", pairs, found)
    found = missed_links(docs, nodes, prints, tagged.select(F.col("text_hash").alias("node"), "root"))
    discard(prints)
    root = tagged.select("text_hash", "root")
    ends = found.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = components(ends).select(F.col("node").alias("root"), F.col("root").alias("_root"))
    tagged = saved(tagged.join(more, "root", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root"), "classes", tagged, nodes, found)
    heads = tagged.groupBy("root").agg(F.min("first").alias("head"))
    return tagged.select("text_hash", "root").join(heads, "root").select(
        "text_hash", F.col("head.doc_id").alias("keep_id"), F.col("head.text_hash").alias("keep_hash")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id."""
    heads = saved(classes(docs).select("keep_id", "keep_hash").distinct(), "heads")
    marked = docs.withColumn(OWN, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(heads["keep_id"]) & (marked[OWN] == heads["keep_hash"])
    return marked.join(heads, same, "left_semi").dropDuplicates(["doc_id", OWN]).drop(OWN)

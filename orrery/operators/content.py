"""Content-addressed sets: deduplication, closures, conflicts, differences, orders, paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orrery.functions.bits import ukey
from orrery.functions.codec import MOST_BYTES
from orrery.session import kept

#: Fixed values, in upper case: names that a path component may not have, whatever its
#: extension, and names that it may not have as they are.
DEVICES = "CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³]"
CONSOLES = "CONIN[$]|CONOUT[$]"


def blob_path(digest: Column) -> Column:
    return F.concat(F.lit("blobs/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".zst"))


def distinct_blobs(rows: DataFrame, digest: str, *least: str) -> DataFrame:
    """One row a digest, with its count and the least of some columns."""
    return rows.groupBy(digest).agg(F.count(F.lit(1)).alias("refs"), *(F.min(c).alias(c) for c in least))


def missing(required: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """The needs: distinct required values that are not present."""
    return required.select(on).distinct().join(present.select(on), on, "left_anti")


def conflicts(refs: DataFrame) -> DataFrame:
    """Paths that are referred to with more than one hash."""
    return refs.groupBy("path").agg(F.count_distinct("hash").alias("hashes"), F.count(F.lit(1)).alias("refs")).where("hashes > 1")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between two (path, hash) tables."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def order_breaks(entries: DataFrame, by: str, position: str) -> DataFrame:
    """Entries whose (level, unsigned key) is not above that of the entry before."""
    w = Window.partitionBy(by).orderBy(position)
    now = F.struct(F.col("level"), ukey(F.col("key")))
    return entries.withColumn("_last", F.lag(now).over(w)).where(F.col("_last") >= now).drop("_last")


def numbered(rows: DataFrame, to: str, *order: Column) -> DataFrame:
    """Adds dense ordinals from 1 in ``order``, which has to tell all rows apart: ranges of
    rows are numbered in parallel, behind the counts of the ranges before."""
    dealt = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row a range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn(to, inside).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return out.select(*rows.columns, (F.col(to) + F.col("_before")).alias(to))


def path_error(path: Column) -> Column:
    """The first rule that an artifact path breaks; null for a good path."""
    parts = F.split(path, "/", -1)
    some = lambda pattern: F.exists(parts, lambda p: F.rlike(p, F.lit(pattern)))
    return (
        F.when(path == "", "empty")
        .when(F.rlike(path, F.lit(r"^/")), "absolute")
        .when(F.rlike(path, F.lit(r"\\")), "backslash")
        .when(some(r"^\.{0,2}$"), "component")
        .when(F.rlike(path, F.lit(r'[<>:"|?*\x00-\x1f]')), "character")
        .when(some(r"[ .]$"), "trailing")
        .when(F.exists(parts, lambda p: F.rlike(F.upper(p), F.lit(rf"^(({DEVICES})([.].*)?|{CONSOLES})$"))), "device")
    )


@F.pandas_udf(StringType())
def collision_key(paths: pd.Series) -> pd.Series:
    """Upper case, then Unicode composition: paths with one key are one file on some system.
    Spark has no normalisation."""
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p.upper()))


def aliases(paths: DataFrame) -> DataFrame:
    """(key, paths, first): keys that several different paths share."""
    keyed = paths.select("path", collision_key("path").alias("key"))
    return keyed.groupBy("key").agg(F.count_distinct("path").alias("paths"), F.min("path").alias("first")).where("paths > 1")


def prefix_collisions(paths: DataFrame) -> DataFrame:
    """(key, below): a path's key that is also a folder of another path's key. Prefixes meet
    keys in an equi-join; pairs of paths are never enumerated."""
    parts = F.split("key", "/", -1)
    tops = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = paths.select(collision_key("path").alias("key")).distinct()
    below = every.select(F.explode(tops).alias("top"), F.col("key").alias("below")).where("top <> below")
    return every.join(below, F.col("key") == F.col("top")).select("key", "below")


def closure_gaps(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, hash, gap): references without their section ("missing") and sections that
    nothing refers to ("extra"); both tables are (path, hash) sets."""
    a, b = refs.select("path", "hash").distinct(), sections.select("path", "hash").distinct()
    return a.exceptAll(b).withColumn("gap", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("gap", F.lit("extra")))


def byte_limit(topology: Column, level: Column, tile_log2: Column, slices: Column, width: Column) -> Column:
    """Bytes that a tile's blob may have: header and dense values, 64 MiB at most and where
    something is unknown."""
    edge = F.power(F.lit(2.0), F.least(level, tile_log2))
    cells = F.when(topology == "cube", edge * edge).when(topology == "radial", edge)
    return F.least(F.lit(MOST_BYTES), F.coalesce(cells * F.coalesce(slices, F.lit(65535)) * F.coalesce(width, F.lit(4)) + 16, F.lit(float(MOST_BYTES)))).cast("long")


def limits(index: DataFrame) -> DataFrame:
    """(digest, limit): the largest limit among the entries (topology, level, tile_log2, slices,
    width, digest) that refer to a blob."""
    own = byte_limit(*(F.col(c) for c in ("topology", "level", "tile_log2", "slices", "width")))
    return index.where("digest is not null").groupBy("digest").agg(F.max(own).alias("limit"))


def merkle(sections: DataFrame, body: str = "body") -> DataFrame:
    """(body, sections, root): a digest of the sorted (path, hash) list of a body's sections;
    a body has as many as its metadata names."""
    listed = F.array_sort(F.collect_set(F.concat_ws("=", "path", "hash")))
    return sections.groupBy(body).agg(F.count_distinct("path", "hash").alias("sections"), F.sha2(F.array_join(listed, ";"), 256).alias("root"))

"""Closures and chains over tables of references, by joins that double or extend paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import kept, sorted_join


def closure(edges: DataFrame) -> DataFrame:
    """(id, needs, depth): all that an id requires, directly (depth 1) or through others, at
    its least depth. An id that requires itself is part of a cycle.

    Each round joins the pairs found last with the edges and drops what is known; written
    rounds end the lineage. The result has as many rows as there are pairs."""
    edges = kept(edges.select("id", "needs").where("id is not null and needs is not null").distinct(), "edges")
    last = known = edges.withColumn("depth", F.lit(1))
    step = edges.select(F.col("id").alias("needs"), F.col("needs").alias("_next"))
    while True:
        more = last.join(sorted_join(step), "needs").select("id", F.col("_next").alias("needs"), (F.col("depth") + 1).alias("depth")).distinct()
        last = kept(more.join(sorted_join(known), ["id", "needs"], "left_anti"), "pairs")
        if last.isEmpty():
            return known
        known = kept(known.unionByName(last), "closure")


def cycles(found: DataFrame) -> DataFrame:
    """(id, depth): the ids of a closure that lie on a cycle, with the shortest one's length."""
    return found.where("id = needs").select("id", "depth")


def chains(rows: DataFrame, value: str) -> DataFrame:
    """(id, end, total, steps, code) for rows (id, base, value): each id's chain of bases, the
    sum of the values along it (the end's is left out), and its length.

    Pointers double in each round, so a chain of n takes log2 n rounds. A chain that ends has a
    row at each distance from its end: when a round closes no row, all open ones never end.
    ``code`` is null for a good chain, "cycle" where it never ends, "dangling" where a base is no
    row's id. Ids are unique."""
    ids = rows.select(F.col("id").alias("base"), F.lit(True).alias("_there"))
    now = rows.join(sorted_join(ids), "base", "left").select(
        "id", F.coalesce("base", "id").alias("end"), F.when(F.col("base").isNull(), 0.0).otherwise(F.col(value).cast("double")).alias("total"),
        F.when(F.col("base").isNull(), 0).otherwise(1).cast("long").alias("steps"), (F.col("base").isNotNull() & F.col("_there").isNull()).alias("lost"),
        (F.col("base").isNotNull() & F.col("_there").isNotNull()).alias("open"),
    )
    now = kept(now, "chains")
    most, round_, before = now.count(), 1, None
    while round_ <= 2 * most and (left := now.where("open").count()) and left != before:
        to = now.select(F.col("id").alias("end"), F.col("end").alias("_end"), F.col("total").alias("_total"), F.col("steps").alias("_steps"), F.col("lost").alias("_lost"), F.col("open").alias("_open"))
        met = now.join(sorted_join(to), "end", "left")
        go = F.col("open")
        now = kept(met.select(
            "id", F.when(go, F.col("_end")).otherwise(F.col("end")).alias("end"), F.when(go, F.col("total") + F.col("_total")).otherwise(F.col("total")).alias("total"),
            F.when(go, F.col("steps") + F.col("_steps")).otherwise(F.col("steps")).alias("steps"), F.when(go, F.col("_lost")).otherwise(F.col("lost")).alias("lost"),
            (go & F.col("_open")).alias("open"),
        ), "chains")
        round_, before = round_ * 2, left
    code = F.when(F.col("open"), "cycle").when(F.col("lost"), "dangling")
    good = lambda c: F.when(code.isNull(), F.col(c)).alias(c)
    return now.select("id", good("end"), good("total"), good("steps"), code.alias("code"))

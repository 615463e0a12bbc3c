"""Point sampling of fields on the cube: nearest, bilinear, tiles with halos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import adjacency, cube
from orrery.functions.bits import fenced

#: Rows of a tile and its ring up to which they are broadcast.
MOST_SENT = 1 << 18


def nearest(points: DataFrame, field: DataFrame, level: int) -> DataFrame:
    """``points`` (id, x, y, z) with the value of the cell that holds them (null if none)."""
    found = cube.locate(points, F.col("x"), F.col("y"), F.col("z"), level)
    return found.join(field.select("face", "i", "j", "value"), ["face", "i", "j"], "left")


def stencil(points: DataFrame, level: int) -> DataFrame:
    """(id, face, i, j, weight): the cells whose centres surround each point.

    Beyond an edge the adjacent face's cell is taken; at a cube corner, where three cells
    meet, the missing one counts as the mean of the two beside it."""
    n = 1 << level
    placed = cube.warped(cube.normalised(points, F.col("x"), F.col("y"), F.col("z")))
    placed = placed.withColumns({"a": F.col("s") * float(n) - 0.5, "b": F.col("t") * float(n) - 0.5})
    placed = placed.withColumns({"i0": F.floor("a"), "j0": F.floor("b")}).withColumns({"fa": F.col("a") - F.col("i0"), "fb": F.col("b") - F.col("j0")})
    placed = fenced(placed.select("id", "face", "i0", "j0", "fa", "fb"), "face", "i0", "j0", "fa", "fb")
    four = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), ((F.col("fa") if p else 1 - F.col("fa")) * (F.col("fb") if q else 1 - F.col("fb"))).alias("weight")) for p in (0, 1) for q in (0, 1)]
    each = placed.select("id", "face", "i0", "j0", F.inline(F.array(*four)))
    each = each.select("id", "face", (F.col("i0") + F.col("p")).alias("gi"), (F.col("j0") + F.col("q")).alias("gj"), "weight")
    inner = {"i": F.least(F.greatest(F.col("gi"), F.lit(0)), F.lit(n - 1)), "j": F.least(F.greatest(F.col("gj"), F.lit(0)), F.lit(n - 1))}
    each = each.withColumns(inner).withColumns({"di": F.col("gi") - F.col("i"), "dj": F.col("gj") - F.col("j")})
    met = adjacency.around(each.select("id", "face", "i", "j", "di", "dj", "weight"), level)
    share = F.when((F.col("di") != 0) & (F.col("dj") != 0), F.col("weight") / 2).otherwise(F.col("weight"))
    return met.select("id", F.col("tface").alias("face"), F.col("ti").alias("i"), F.col("tj").alias("j"), share.alias("weight"))


def bilinear(points: DataFrame, field: DataFrame, level: int) -> DataFrame:
    """(id, value, weight): weighted mean of the stencil's cells that have a value; null with
    weight 0 where none has."""
    met = stencil(points, level).join(field.select("face", "i", "j", "value"), ["face", "i", "j"], "left")
    known = F.when(F.col("value").isNotNull(), F.col("weight"))
    sums = met.groupBy("id").agg(F.sum(F.col("weight") * F.col("value")).alias("_s"), F.coalesce(F.sum(known), F.lit(0.0)).alias("weight"))
    return sums.select("id", F.when(F.col("weight") > 0, F.col("_s") / F.col("weight")).alias("value"), "weight")


def finest(points: DataFrame, field: DataFrame, level: int) -> DataFrame:
    """``points`` (id, x, y, z) with the value of the finest stored cell, at ``level`` or above,
    that holds them: (id, value, raw, level_used, key, source).

    ``field`` (level, key, raw, value) holds a pyramid. A point asks for its cell at every
    level by that cell's key, in one equi-join; the deepest answer counts. Source is native
    where that is ``level`` itself, pyramid where a coarser cell stands in, null for none."""
    at = cube.locate(points, F.col("x"), F.col("y"), F.col("z"), level)
    keyed = at.select("id", cube.key(F.col("face"), F.col("i"), F.col("j"), level).alias("own"))
    each = F.array(*(F.struct(F.lit(up).alias("level"), cube.ancestor(F.col("own"), up).alias("key")) for up in range(level + 1)))
    asked = keyed.select("id", F.inline(F.when(F.col("own").isNotNull(), each)))
    found = asked.join(field.select("level", "key", "raw", "value"), ["level", "key"])
    best = found.groupBy("id").agg(F.max(F.struct(F.col("level").alias("level_used"), "key", "raw", "value")).alias("b")).select("id", "b.*")
    source = F.when(F.col("level_used") == level, "native").when(F.col("level_used").isNotNull(), "pyramid")
    return points.select("id").join(best, "id", "left").select("id", "value", "raw", "level_used", "key", source.alias("source"))


def tile_with_halo(field: DataFrame, face: int, i: int, j: int, level: int, tile_log2: int) -> DataFrame:
    """The cells of the tile at (face, i, j) in tile units and one ring around it:
    (gi, gj, value), gi and gj from -1 to the tile's edge; corners of the ring are left
    out where the cube has none."""
    size, n = 1 << min(level, tile_log2), 1 << level
    spark = field.sparkSession
    ring = spark.range((size + 2) ** 2).select((F.expr(f"id div {size + 2}") - 1).alias("gi"), (F.col("id") % (size + 2) - 1).alias("gj"))
    at = ring.withColumns({"face": F.lit(face), "a": F.col("gi") + i * size, "b": F.col("gj") + j * size})
    edge = F.when(F.col("a") < 0, 0).when(F.col("a") >= n, 1).when(F.col("b") < 0, 2).when(F.col("b") >= n, 3)
    outside = (F.col("a").between(0, n - 1)).cast("int") + F.col("b").between(0, n - 1).cast("int")
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1))
    at = at.where(outside > 0).select("gi", "gj", "face", clip("a").alias("i"), clip("b").alias("j"), edge.alias("edge"))
    inner = at.where("edge is null").drop("edge")
    outer = adjacency.step(at.where("edge is not null"), level).select("gi", "gj", F.col("nface").alias("face"), F.col("ni").alias("i"), F.col("nj").alias("j"))
    asked = inner.unionByName(outer)
    asked = F.broadcast(asked) if (size + 2) ** 2 <= MOST_SENT else asked
    return field.select("face", "i", "j", "value").join(asked, ["face", "i", "j"]).select("gi", "gj", "value")

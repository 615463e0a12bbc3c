"""Face adjacency of the cube and neighbour lookup across edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.cube import FACE_XYZ

EDGES = ("U-", "U+", "V-", "V+")


def rows() -> list[tuple[int, int, int, int, bool]]:
    """(face, edge, to_face, to_edge, flip), edges by their place in EDGES: two faces meet
    where their edges end in the same corners of the cube; flip where these are reversed."""

    def corner(face: int, u: int, v: int) -> tuple[int, ...]:
        known = {"1e0": 1, "-1e0": -1, "u": u, "-u": -u, "v": v, "-v": -v}
        return tuple(known[x] for x in FACE_XYZ[face])

    ends = {}
    for face in FACE_XYZ:
        for edge in range(4):
            rim = -1 if edge % 2 == 0 else 1
            ends[face, edge] = [corner(face, rim, t) if edge < 2 else corner(face, t, rim) for t in (-1, 1)]
    met = [(a, b) for a in ends for b in ends if a[0] != b[0] and set(ends[a]) == set(ends[b])]
    return [(*a, *b, ends[a][0] != ends[b][0]) for a, b in met]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "face int, edge int, to_face int, to_edge int, flip boolean")


def step(cells: DataFrame, level: int) -> DataFrame:
    """Adds nface, ni, nj: the cell beyond ``edge`` of each cell (face, i, j, edge).

    The 24 rows of the table are a broadcast whose size is fixed."""
    n = 1 << level
    inside = F.expr(f"case edge when 0 then i > 0 when 1 then i < {n - 1} when 2 then j > 0 else j < {n - 1} end")
    along = F.when(F.col("edge") < 2, F.col("j")).otherwise(F.col("i"))
    met = cells.join(F.broadcast(table(cells.sparkSession)), ["face", "edge"])
    met = met.withColumns({"_in": inside, "_a": F.when(F.col("flip"), n - 1 - along).otherwise(along)})
    end = F.when(F.col("to_edge") % 2 == 0, F.lit(0)).otherwise(F.lit(n - 1))
    return met.withColumns(
        {
            "nface": F.when(F.col("_in"), F.col("face")).otherwise(F.col("to_face")),
            "ni": F.when(F.col("_in"), F.col("i") + F.expr("case edge when 0 then -1 when 1 then 1 else 0 end")).when(F.col("to_edge") < 2, end).otherwise(F.col("_a")).cast("long"),
            "nj": F.when(F.col("_in"), F.col("j") + F.expr("case edge when 2 then -1 when 3 then 1 else 0 end")).when(F.col("to_edge") < 2, F.col("_a")).otherwise(end).cast("long"),
        }
    ).drop("to_face", "to_edge", "flip", "_in", "_a")


def neighbours(cells: DataFrame, level: int) -> DataFrame:
    """Four rows for each cell (face, i, j), with edge and nface, ni, nj."""
    return step(cells.withColumn("edge", F.explode(F.array(*map(F.lit, range(4))))), level)


def corner_stencil(cells: DataFrame, level: int) -> DataFrame:
    """For cells at a face's corner their two neighbours beyond it: (face, i, j, corner,
    uface, ui, uj, vface, vi, vj); at level 0, where all corners fall on the cell, the
    lesser edges."""
    n = 1 << level
    low_i, low_j = F.col("i") == 0, F.col("j") == 0
    at = (low_i | (F.col("i") == n - 1)) & (low_j | (F.col("j") == n - 1))
    sides = cells.where(at).withColumns({"eu": F.when(low_i, 0).otherwise(1), "ev": F.when(low_j, 2).otherwise(3)})
    keep = ["face", "i", "j"]
    one = step(sides.withColumn("edge", F.col("eu")), level).select(*keep, "eu", "ev", F.col("nface").alias("uface"), F.col("ni").alias("ui"), F.col("nj").alias("uj"))
    two = step(one.withColumn("edge", F.col("ev")), level)
    return two.select(*keep, "eu", "ev", "uface", "ui", "uj", F.col("nface").alias("vface"), F.col("ni").alias("vi"), F.col("nj").alias("vj"))


def around(cells: DataFrame, level: int, di: str = "di", dj: str = "dj") -> DataFrame:
    """Adds tface, ti, tj: the cell at the offset (di, dj), each -1, 0 or 1, of each cell.

    Beyond an edge that is the adjacent face's cell. Where an offset leaves a face at its
    corner, the cube has no cell there: the row becomes two, one for each edge, whose cells
    stand for the missing one by their mean."""
    n, names = 1 << level, cells.columns
    at = cells.withColumns({"_gi": F.col("i") + F.col(di), "_gj": F.col("j") + F.col(dj)})
    out_u = F.when(F.col("_gi") < 0, 0).when(F.col("_gi") >= n, 1)
    out_v = F.when(F.col("_gj") < 0, 2).when(F.col("_gj") >= n, 3)
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1)).cast("long")
    both = F.when(out_u.isNotNull() & out_v.isNotNull(), F.array(out_u, out_v)).otherwise(F.array(F.coalesce(out_u, out_v)))
    at = at.select(F.struct(*names).alias("_own"), "face", clip("_gi").alias("i"), clip("_gj").alias("j"), F.explode(both).alias("edge"))
    inside = at.where("edge is null").select("_own.*", F.col("face").alias("tface"), F.col("i").alias("ti"), F.col("j").alias("tj"))
    across = step(at.where("edge is not null"), level).select("_own.*", F.col("nface").alias("tface"), F.col("ni").alias("ti"), F.col("nj").alias("tj"))
    return inside.unionByName(across)

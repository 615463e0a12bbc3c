"""Cube-sphere cells: addressing, keys and geometry.

A cell is (face, i, j) at a level with N = 2^level cells an edge. Its key holds the face
in the top three bits, then the quadrant path, i before j, then a marker bit.
Points and cells are columns of a DataFrame; functions add columns to it, so that each
intermediate result is computed once in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.bits import compact, fenced, spread, trailing_zeros

MAX_LEVEL = 30
#: Per face the components (u, v) from (x, y, z), and back.
FACE_UV = {0: ("y/x", "z/x"), 1: ("-x/y", "z/y"), 2: ("-x/z", "-y/z"), 3: ("z/x", "y/x"), 4: ("z/y", "-x/y"), 5: ("-y/z", "-x/z")}
FACE_XYZ = {0: ("1e0", "u", "v"), 1: ("-u", "1e0", "v"), 2: ("-u", "-v", "1e0"), 3: ("-1e0", "-v", "-u"), 4: ("v", "-1e0", "-u"), 5: ("v", "u", "-1e0")}


def _by_face(forms: dict, at: int, names: dict[str, str]) -> Column:
    out = None
    for face, row in forms.items():
        text = "".join(names.get(c, c) for c in row[at]) if names else row[at]
        out = F.when(F.col("face") == face, F.expr(text)) if out is None else out.when(F.col("face") == face, F.expr(text))
    return out


def normalised(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    """Adds the unit vector (dx, dy, dz); null where a component is not finite or all are zero."""
    df = df.withColumns({"_x": x.cast("double"), "_y": y.cast("double"), "_z": z.cast("double")})
    df = df.withColumn("_m", F.greatest(F.abs("_x"), F.abs("_y"), F.abs("_z")))
    df = df.withColumn("_m", F.when((F.col("_m") > 0) & (F.col("_m") < float("inf")), F.col("_m")))
    df = df.withColumns({c: F.col(c) / F.col("_m") for c in ("_x", "_y", "_z")})
    df = df.withColumn("_n", F.expr("sqrt(_x*_x + _y*_y + _z*_z)"))
    return df.withColumns({"dx": F.col("_x") / F.col("_n"), "dy": F.col("_y") / F.col("_n"), "dz": F.col("_z") / F.col("_n")}).drop("_x", "_y", "_z", "_m", "_n")


def warped(df: DataFrame) -> DataFrame:
    """Adds face and the warped face coordinates s, t in [0, 1] of (dx, dy, dz)."""
    face = F.expr(
        """case when abs(dx) >= abs(dy) and abs(dx) >= abs(dz) then if(dx >= 0, 0, 3)
                when abs(dy) >= abs(dz) then if(dy >= 0, 1, 4) else if(dz >= 0, 2, 5) end"""
    )
    names = {"x": "dx", "y": "dy", "z": "dz"}
    df = df.withColumn("face", F.when(F.col("dx").isNotNull(), face))
    df = df.withColumns({"u": _by_face(FACE_UV, 0, names), "v": _by_face(FACE_UV, 1, names)})
    warp = "case when {0} >= 0 then 0.5e0*sqrt(1e0+3e0*{0}) else 1e0-0.5e0*sqrt(1e0-3e0*{0}) end"
    return df.withColumns({"s": F.expr(warp.format("u")), "t": F.expr(warp.format("v"))}).drop("u", "v")


def indexed(df: DataFrame, level: int) -> DataFrame:
    n = 1 << level
    place = lambda c: F.least(F.floor(F.col(c) * float(n)), F.lit(n - 1)).cast("long")
    return df.withColumns({"i": place("s"), "j": place("t")})


def locate(df: DataFrame, x: Column, y: Column, z: Column, level: int) -> DataFrame:
    """Adds face, i, j of the cell that holds the direction (x, y, z)."""
    found = indexed(warped(normalised(df, x, y, z)), level)
    return fenced(found.drop("dx", "dy", "dz", "s", "t"), "face", "i", "j")


def key(face: Column, i: Column, j: Column, level: int) -> Column:
    path = F.shiftleft(spread(i), 1).bitwiseOR(spread(j))
    return F.shiftleft(face.cast("long"), 61).bitwiseOR(F.shiftleft(path, 61 - 2 * level)).bitwiseOR(F.lit(1 << (60 - 2 * level)))


def decoded(df: DataFrame, k: str = "key") -> DataFrame:
    """Adds level, face, i, j of a key; null for bits that are no key."""
    zeros = trailing_zeros(F.col(k))
    df = df.withColumn("_tz", zeros)
    face = F.shiftrightunsigned(k, 61)
    fine = (F.col("_tz") <= 60) & (F.col("_tz") % 2 == 0) & (face <= 5)
    df = df.withColumn("level", F.when(fine, ((60 - F.col("_tz")) / 2).cast("int")))
    df = df.withColumn("_path", F.expr(f"shiftrightunsigned({k} & {(1 << 61) - 1}L, _tz + 1)"))
    some = F.col("level").isNotNull()
    return df.withColumns(
        {"face": F.when(some, face.cast("int")), "i": F.when(some, compact(F.shiftrightunsigned("_path", 1))), "j": F.when(some, compact(F.col("_path")))}
    ).drop("_tz", "_path")


def ancestor(k: Column, level: int) -> Column:
    """The key at ``level`` above a key of that level or a deeper one."""
    marker = 1 << (60 - 2 * level)
    return k.bitwiseAND(F.lit(-(marker << 1))).bitwiseOR(F.lit(marker))


def subtree(k: int) -> tuple[int, int]:
    """The range of keys of a cell and all that lie in it; it never meets the sign bit."""
    marker = k & -k
    return k - (marker - 1), k + (marker - 1)


def tile_key(face: Column, i: Column, j: Column, level: int, tile_log2: int) -> Column:
    up = min(level, tile_log2)
    return key(face, F.shiftright(i, up), F.shiftright(j, up), level - up)


def is_unit(x: Column, y: Column, z: Column) -> Column:
    """Whether a vector is a direction: its squared length is 1 within 1e-12."""
    return F.coalesce(F.abs(x * x + y * y + z * z - 1.0) <= 1e-12, F.lit(False))


def is_tile_key(df: DataFrame, k: str, level: str, tile_log2: int, to: str = "is_tile") -> DataFrame:
    """Adds whether a key is that of a tile of cells at ``level``: a cell's key, at the level
    max(0, level - tile_log2)."""
    marks = trailing_zeros(F.col(k))
    up = F.greatest(F.lit(0), F.col(level) - tile_log2)
    good = F.col(level).between(0, MAX_LEVEL) & (marks == 60 - 2 * up) & (F.shiftrightunsigned(k, 61) <= 5)
    return df.withColumn(to, F.coalesce(good, F.lit(False)))


def with_axial(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """Adds the direction (dx, dy, dz) at an axial latitude and longitude in radians."""
    return df.withColumns({"dx": F.cos(lat) * F.cos(lon), "dy": F.cos(lat) * F.sin(lon), "dz": F.sin(lat)})


def with_direction(df: DataFrame, s: Column, t: Column, prefix: str = "c") -> DataFrame:
    """Adds the unit vector (prefix x, y, z) at face coordinates (s, t) of column face."""
    bend = "case when {0} >= 0.5e0 then (4e0*{0}*{0}-1e0)/3e0 else (1e0-4e0*(1e0-{0})*(1e0-{0}))/3e0 end"
    df = df.withColumns({"_s": s, "_t": t})
    df = df.withColumns({"u": F.expr(bend.format("_s")), "v": F.expr(bend.format("_t"))})
    df = df.withColumns({f"_{a}": _by_face(FACE_XYZ, k, {}) for k, a in enumerate("xyz")})
    df = df.withColumn("_n", F.expr("sqrt(_x*_x + _y*_y + _z*_z)"))
    return df.withColumns({f"{prefix}{a}": F.col(f"_{a}") / F.col("_n") for a in "xyz"}).drop("_s", "_t", "u", "v", "_x", "_y", "_z", "_n")


def with_center(df: DataFrame, level: int) -> DataFrame:
    n = float(1 << level)
    return with_direction(df, (F.col("i") + 0.5) / n, (F.col("j") + 0.5) / n)


def with_measure(df: DataFrame, level: int, to: str = "measure") -> DataFrame:
    """Adds the solid angle of the cells (face, i, j): two spherical triangles."""
    n = float(1 << level)
    for name, a, b in (("p", 0, 0), ("q", 1, 0), ("r", 1, 1), ("w", 0, 1)):
        df = with_direction(df, (F.col("i") + a) / n, (F.col("j") + b) / n, name)
    dot = lambda a, b: f"({a}x*{b}x + {a}y*{b}y + {a}z*{b}z)"

    def triangle(a: str, b: str, c: str) -> str:
        cross = f"({a}x*({b}y*{c}z - {b}z*{c}y) + {a}y*({b}z*{c}x - {b}x*{c}z) + {a}z*({b}x*{c}y - {b}y*{c}x))"
        return f"2e0*atan2(abs({cross}), 1e0 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)})"

    df = df.withColumn(to, F.expr(f"{triangle('p', 'q', 'r')} + {triangle('p', 'r', 'w')}"))
    return df.drop(*(f"{p}{a}" for p in "pqrw" for a in "xyz"))


def with_latlon(df: DataFrame) -> DataFrame:
    """Adds axial latitude and longitude in radians of (dx, dy, dz)."""
    return df.withColumns({"lat": F.expr("atan2(dz, sqrt(dx*dx + dy*dy))"), "lon": F.expr("atan2(dy, dx)")})

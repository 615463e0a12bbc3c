"""Aggregations over cells: pyramids, weighted statistics, histograms, tiles, time slices.

Every function is one grouping of a cells table, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import cube


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down, exact for all longs (``div`` rounds toward zero)."""
    a, b = a.cast("long"), b.cast("long")
    rest = a % b
    return F.call_function("div", a, b) - ((rest != 0) & ((rest < 0) != (b < 0))).cast("long")


def quantised(value: Column, scale: float, offset: float) -> Column:
    return F.floor((value - offset) / scale + 0.5)


def decoded(raw: Column, scale: float, offset: float, nodata: int | None = None) -> Column:
    """raw * scale + offset; the sentinel is compared with the raw value."""
    kept = raw if nodata is None else F.when(raw != nodata, raw)
    return kept.cast("double") * scale + offset


def dtype_fits(raw: Column, dtype: Column) -> Column:
    """Whether a raw value fits its storage type; f32 holds 32 bits of a pattern.
    Fixed values: the types' names and ranges."""
    ranges = {"u8": (0, 255), "i8": (-128, 127), "u16": (0, 65535), "i16": (-32768, 32767), "u32": (0, 4294967295), "i32": (-2147483648, 2147483647), "f32": (0, 4294967295)}
    out = None
    for name, (low, high) in ranges.items():
        out = F.when(dtype == name, raw.between(low, high)) if out is None else out.when(dtype == name, raw.between(low, high))
    return F.coalesce(out, F.lit(False))


def reduced(op: str, raw: str = "raw") -> Column:
    """One of the integer reductions; nodata (null) is left out, all nodata gives null.

    mean rounds half up, rms rounds half up, mode takes the lowest of the most frequent.
    Squares are summed by halves of 16 bits, so that no storage type's values overflow."""
    v, n = F.col(raw).cast("long"), F.count(raw)
    high, low = F.shiftright(v, 16), v.bitwiseAND(F.lit(0xFFFF))
    squares = F.sum(high * high).cast("double") * float(1 << 32) + F.sum(high * low).cast("double") * float(1 << 17) + F.sum(low * low).cast("double")
    return {
        "mean": F.when(n > 0, floor_div(2 * F.sum(v) + n, 2 * n)),
        "min": F.min(v),
        "max": F.max(v),
        "sum": F.sum(v),
        "rms": F.floor(F.sqrt(squares / n) + 0.5),
        "mode": F.mode(v, True),
    }[op]


def pyramid(cells: DataFrame, op: str, raw: str = "raw", by: tuple = ()) -> DataFrame:
    """The level above: (face, i, j, raw) of the four children by ``op``."""
    up = cells.withColumns({"i": F.shiftright("i", 1), "j": F.shiftright("j", 1)})
    return up.groupBy(*by, "face", "i", "j").agg(reduced(op, raw).alias(raw))


def shells_up(cells: DataFrame, op: str, raw: str = "raw") -> DataFrame:
    """The radial level above, by pairs."""
    return cells.withColumn("idx", F.shiftright("idx", 1)).groupBy("idx").agg(reduced(op, raw).alias(raw))


def weighted_stats(cells: DataFrame, level: int, value: str, by: tuple = ()) -> DataFrame:
    """Mean and variance by the cells' solid angles, and their area."""
    w = cube.with_measure(cells.where(F.col(value).isNotNull()), level, "_w")
    sums = w.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("_w").alias("area"), F.sum(F.col(value) * F.col("_w")).alias("_s"), F.sum(F.col(value) * F.col(value) * F.col("_w")).alias("_q"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return sums.withColumns({"mean": F.col("_s") / F.col("area"), "variance": F.col("_q") / F.col("area") - (F.col("_s") / F.col("area")) * (F.col("_s") / F.col("area"))}).drop("_s", "_q")


def histogram(cells: DataFrame, level: int, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, cells, area): cells by value in equal bins over [low, high], ends included."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * float(bins)), F.lit(bins - 1))
    kept = cells.where(F.col(value).between(low, high)).withColumn("bin", at.cast("int"))
    return cube.with_measure(kept, level, "_w").groupBy("bin").agg(F.count(F.lit(1)).alias("cells"), F.sum("_w").alias("area"))


def tiles(cells: DataFrame, level: int, tile_log2: int, raw: str = "raw") -> DataFrame:
    """(tile, cells, is_const, const_raw): a tile is constant if its cells all agree."""
    keyed = cells.withColumn("tile", cube.tile_key(F.col("face"), F.col("i"), F.col("j"), level, tile_log2))
    low, high = F.min(raw), F.max(raw)
    same = (low == high) & (F.count(raw) == F.count(F.lit(1)))
    return keyed.groupBy("tile").agg(F.count(F.lit(1)).alias("cells"), F.coalesce(same, F.lit(False)).alias("is_const"), F.when(same, low).alias("const_raw"))


def time_slice(micros: Column, origin: int, period: int, count: int) -> Column:
    """The k in [0, count) with the phase of the time in [k / count, (k + 1) / count)."""
    return floor_div(F.pmod(micros - origin, F.lit(period)) * count, F.lit(period)).cast("int")

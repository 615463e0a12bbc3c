"""Radial shells: N = 2^level equal steps of an extent, addressed as a binary heap."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def locate(r: Column, extent: Column, level: int) -> Column:
    n = 1 << level
    return F.least(F.floor(r / extent * float(n)), F.lit(n - 1)).cast("long")


def key(index: Column, level: int) -> Column:
    return F.lit(1 << level).bitwiseOR(index)


def level_of(k: Column) -> Column:
    """Level of a key; null for keys out of range."""
    return F.when((k > 0) & (k < 1 << 31), F.length(F.bin(k)) - 1)


def index_of(k: Column) -> Column:
    return k - F.power(F.lit(2.0), level_of(k)).cast("long")


def center(index: Column, extent: Column, level: int) -> Column:
    return (index + 0.5) / float(1 << level) * extent


def measure(index: Column, extent: Column, level: int) -> Column:
    """Volume of a shell of a sphere of radius ``extent``. Fixed form: the order of the
    operations, on which the last bits depend."""
    inner, outer = index / float(1 << level), (index + 1) / float(1 << level)
    return F.lit(4.0 * math.pi / 3.0) * extent * extent * extent * (outer - inner) * (outer * outer + outer * inner + inner * inner)


def tile_key(index: Column, level: int, tile_log2: int) -> Column:
    return key(F.shiftright(index, min(level, tile_log2)), level)


def clamped(index: Column, by: int, level: int) -> Column:
    return F.least(F.greatest(index + by, F.lit(0)), F.lit((1 << level) - 1))


def is_extent(extent: Column) -> Column:
    """Whether a radius can be divided into shells: the whole sphere and the innermost shell
    of the deepest level have finite volumes above zero."""
    sizes = [measure(F.lit(0), extent, level) for level in (0, 30)]
    return F.coalesce((extent > 0) & (extent < float("inf")) & (sizes[0] < float("inf")) & (sizes[1] > 0), F.lit(False))


def is_tile_key(k: Column, level: Column, tile_log2: int) -> Column:
    """Whether a key is that of a tile of shells at ``level``: at that level itself, with an
    ordinal below 2^(level - tile_log2)."""
    ordinal = k - F.power(F.lit(2.0), level).cast("long")
    return F.coalesce(level.between(0, 30) & (level_of(k) == level) & (ordinal < F.power(F.lit(2.0), F.greatest(F.lit(0), level - tile_log2))), F.lit(False))

"""SplitMix64 finaliser and the detail hash, as projections.

Each step is a column of its own so that the optimizer keeps one copy of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.bits import add64, mul64, mul64_text, signed

#: The finaliser's shifts and factors, the golden-ratio increment.
STEPS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))
GOLDEN = 0x9E3779B97F4A7C15


def with_mix64(df: DataFrame, source: str, to: str) -> DataFrame:
    return with_mixes(df, {to: source})


def with_mixes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a mixed column for each (to, source), all in the same few projections."""
    df = df.withColumns({to: F.col(source) for to, source in columns.items()})
    for shift, factor in STEPS:
        df = df.withColumns({c: F.col(c).bitwiseXOR(F.shiftrightunsigned(c, shift)) for c in columns})
        if factor:
            df = df.withColumns({c: F.expr(mul64_text(c, factor)) for c in columns})
    return df


def with_detail_hash(df: DataFrame, seed: int, parent: str, quadrant: str, to: str) -> DataFrame:
    """mix64(mix64(seed ^ parent) + quadrant * GOLDEN)."""
    df = with_mix64(df.withColumn("_x", F.col(parent).bitwiseXOR(F.lit(signed(seed)))), "_x", "_y")
    df = df.withColumn("_x", add64(F.col("_y"), mul64(F.col(quadrant).cast("long"), GOLDEN)))
    return with_mix64(df, "_x", to).drop("_x", "_y")


def with_detail_hashes(df: DataFrame, seed: int, parent: str, to: list[str]) -> DataFrame:
    """The detail hashes of the quadrants 0, 1, ...; the parent is mixed once for all."""
    df = with_mix64(df.withColumn("_x", F.col(parent).bitwiseXOR(F.lit(signed(seed)))), "_x", "_y")
    df = df.withColumns({f"_x{q}": add64(F.col("_y"), F.lit(signed(q * GOLDEN % (1 << 64)))) for q in range(len(to))})
    return with_mixes(df, {name: f"_x{q}" for q, name in enumerate(to)}).drop("_x", "_y", *(f"_x{q}" for q in range(len(to))))

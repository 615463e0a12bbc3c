"""The adapters that give the grid operators rows from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import cube
from orrery.session import table


def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions: (id, x, y, z) from the first components of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))


def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions with values: (x, y, z, value, category, ...) from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_quantity - 25.5e0").alias("x"), F.expr("l_extendedprice / 1000e0 - 50e0").alias("y"), F.expr("l_discount * 100e0 - 5.05e0 + l_tax").alias("z"),
        F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("category"), "l_orderkey", "l_quantity", "l_discount",
    )


def cells(points: DataFrame, level: int) -> DataFrame:
    """The points with face, i, j of their cells."""
    return cube.locate(points, F.col("x"), F.col("y"), F.col("z"), level)

"""Tiled fields in storage: packed blobs, deduplicated by content, and an index.

A field is two Parquet tables below a path. ``index`` has a row a tile (field_id, level,
tile_log2, key, is_const, const_raw, digest); ``blobs`` a row for each distinct content (digest,
payload). Constant tiles have no blob. The index is written last, so a folder without it was
not completed. Reading joins the tiles asked for with the blobs and decodes those alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import codec, cube
from orrery.operators import content
from orrery.operators.grid import dtype_fits


def unfit(cells: DataFrame, dtype: str) -> DataFrame:
    """Cells (face, i, j, raw) whose value the storage type cannot hold, or that come twice."""
    wrong = cells.where(~dtype_fits(F.col("raw"), F.lit(dtype))).select("face", "i", "j", F.lit("range").alias("code"))
    twice = cells.groupBy("face", "i", "j").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return wrong.unionByName(twice.select("face", "i", "j", F.lit("repeated").alias("code")))


def write(cells: DataFrame, path: str, field_id: int, level: int, tile_log2: int, dtype: str, nodata: int) -> None:
    """Write cells (face, i, j, raw) of one level; missing cells and nulls are nodata.
    Nothing is written where a value does not fit the type or a cell is repeated."""
    size = 1 << min(level, tile_log2)
    low, high = codec.RANGES[dtype]
    if not low <= nodata <= high:
        raise ValueError("nodata does not fit the storage type")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((1, size, size), nodata, np.int64)
        seen = np.zeros(grid.shape, np.int64)
        place = 0, pdf["j"].to_numpy() % size, pdf["i"].to_numpy() % size
        np.add.at(seen, place, 1)
        known = pdf["raw"].notna().to_numpy()
        grid[0, place[1][known], place[2][known]] = pdf["raw"][known].to_numpy()
        if seen.max() > 1 or grid.min() < low or grid.max() > high:
            raise ValueError("a cell is repeated or does not fit the storage type")
        const = bool((grid == grid.flat[0]).all())
        payload = None if const else codec.store(codec.pack_raster(grid, dtype))
        return pd.DataFrame({"key": [int(pdf["key"].iloc[0])], "is_const": [const], "const_raw": [int(grid.flat[0]) if const else None], "payload": [payload]})

    keyed = cells.select(cube.tile_key(F.col("face"), F.col("i"), F.col("j"), level, tile_log2).alias("key"), "i", "j", "raw")
    tiles = keyed.groupBy("key").applyInPandas(pack, "key long, is_const boolean, const_raw long, payload binary").withColumn("digest", F.sha2("payload", 256))
    staged = f"{path}/staged"
    tiles.write.mode("errorifexists").parquet(staged)
    done = cells.sparkSession.read.parquet(staged)
    done.where("payload is not null").select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/blobs")
    index = done.select(F.lit(field_id).alias("field_id"), F.lit(level).alias("level"), F.lit(tile_log2).alias("tile_log2"), "key", "is_const", "const_raw", "digest")
    commit(index, path)


def commit(index: DataFrame, path: str) -> None:
    """Write the index, and so complete the folder; refused where a blob is missing or a
    tile of a field is there twice."""
    blobs = index.sparkSession.read.parquet(f"{path}/blobs")
    if content.missing(index.where("digest is not null"), blobs, "digest").limit(1).count():
        raise ValueError("a blob is missing")
    if index.groupBy("field_id", "level", "key").count().where("count > 1").limit(1).count():
        raise ValueError("a tile is repeated")
    index.sort("key").write.mode("errorifexists").parquet(f"{path}/index")


def needs(spark: SparkSession, path: str) -> DataFrame:
    """Digests that the index refers to and that have no blob."""
    return content.missing(spark.read.parquet(f"{path}/index").where("digest is not null"), spark.read.parquet(f"{path}/blobs"), "digest")


def tampered(spark: SparkSession, path: str) -> DataFrame:
    """Digests of blobs whose content is another."""
    return spark.read.parquet(f"{path}/blobs").where(F.sha2("payload", 256) != F.col("digest")).select("digest")


def misfits(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """(key, code): tiles whose blob is no whole frame, no raster, or of another type or
    size than the index says."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = []
            for edge, payload in zip(pdf["edge"], pdf["payload"], strict=True):
                try:
                    grid = codec.unpack_raster(codec.restore(bytes(payload)))
                    code = "dtype" if grid.dtype != np.dtype(codec.DTYPES[dtype][1]) else None
                    codes.append(code or ("dimensions" if grid.shape[1:] != (edge, edge) else "slices" if grid.shape[0] != 1 else None))
                except ValueError:
                    codes.append("blob")
            yield pd.DataFrame({"key": pdf["key"], "code": codes}).dropna()

    return _met(spark.read.parquet(f"{path}/index"), spark, path).select("key", "edge", "payload").mapInPandas(judge, "key long, code string")


def _met(index: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    edge = F.call_function("shiftleft", F.lit(1), F.least("level", "tile_log2"))
    return index.where("not is_const").withColumn("edge", edge).join(spark.read.parquet(f"{path}/blobs"), "digest")


def read(spark: SparkSession, path: str, nodata: int, tiles: DataFrame | None = None) -> DataFrame:
    """Cells (face, i, j, raw); ``tiles`` (key) limits what is decoded. Constant tiles become
    rows without touching a blob; each other tile is decoded where its blob meets it."""
    index = spark.read.parquet(f"{path}/index")
    if tiles is not None:
        index = index.join(tiles.select("key").distinct(), "key", "left_semi")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, payload in zip(pdf["key"], pdf["payload"], strict=True):
                grid = codec.unpack_raster(codec.restore(bytes(payload)))[0]
                j, i = np.nonzero(grid != nodata)
                yield pd.DataFrame({"key": key, "size": grid.shape[0], "di": i, "dj": j, "raw": grid[j, i].astype(np.int64)})

    dense = _met(index, spark, path).select("key", "payload").mapInPandas(unpack, "key long, size int, di int, dj int, raw long")
    const = index.where(F.col("is_const") & (F.col("const_raw") != nodata)).withColumn("size", F.call_function("shiftleft", F.lit(1), F.least("level", "tile_log2")))
    const = const.select("key", "size", "const_raw", F.explode(F.sequence(F.lit(0), F.col("size") * F.col("size") - 1)).alias("at"))
    const = const.select("key", "size", (F.col("at") % F.col("size")).alias("di"), F.expr("cast(at div size as int)").alias("dj"), F.col("const_raw").alias("raw"))
    tile = cube.decoded(dense.unionByName(const))
    return tile.select("face", (F.col("i") * F.col("size") + F.col("di")).alias("i"), (F.col("j") * F.col("size") + F.col("dj")).alias("j"), "raw")

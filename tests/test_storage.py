"""Tiled storage: round trip, deduplication, constants, missing and damaged content."""

import pytest
from pyspark.sql import functions as F

from orrery.sources import tiles


@pytest.fixture()
def stored(spark, tmp_path):
    cells = spark.range(6 * 64).selectExpr("cast(id div 64 as int) as face", "id div 8 % 8 as i", "id % 8 as j")
    # faces 0 and 1 hold the same values, face 2 is constant, face 3 is missing, others differ
    cells = cells.where("face <> 3").withColumn("raw", F.expr("case when face < 2 then i * 8 + j when face = 2 then 7 else face * 100 + i end").cast("long"))
    path = str(tmp_path / "field")
    tiles.write(cells, path, 1 << 16 | 1, 3, 3, "u16", 65535)
    return cells, path


def test_round_trip(spark, stored):
    cells, path = stored
    back = tiles.read(spark, path, 65535)
    own = [F.col("face").cast("int").alias("face"), "i", "j", "raw"]
    assert back.select(*own).exceptAll(cells.select(*own)).count() == 0
    assert cells.select(*own).exceptAll(back.select(*own)).count() == 0
    index = spark.read.parquet(f"{path}/index")
    assert [r.const_raw for r in index.where("is_const").collect()] == [7]


def test_equal_content_is_stored_once(spark, stored):
    _, path = stored
    assert spark.read.parquet(f"{path}/blobs").count() == 3
    assert tiles.needs(spark, path).count() == 0
    assert tiles.tampered(spark, path).count() == 0


def test_some_tiles_only(spark, stored):
    _, path = stored
    keys = spark.read.parquet(f"{path}/index").where("not is_const").orderBy("key").limit(1)
    assert tiles.read(spark, path, 65535, keys).select("face").distinct().count() == 1


def test_existing_fields_are_not_overwritten(spark, stored):
    cells, path = stored
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tiles.write(cells, path, 1, 3, 3, "u16", 65535)


def test_what_does_not_fit_is_refused(spark, tmp_path):
    cells = spark.range(64).selectExpr("0 as face", "id div 8 as i", "id % 8 as j", "id + 250 as raw")
    assert tiles.unfit(cells, "u8").count() == 58
    with pytest.raises(Exception, match="does not fit"):
        tiles.write(cells, str(tmp_path / "a"), 1 << 16 | 1, 3, 3, "u8", 0)
    twice = cells.withColumn("raw", F.lit(1)).unionByName(cells.limit(1).withColumn("raw", F.lit(2)))
    assert [r.code for r in tiles.unfit(twice, "u8").collect()] == ["repeated"]
    with pytest.raises(Exception, match="repeated"):
        tiles.write(twice, str(tmp_path / "b"), 1 << 16 | 1, 3, 3, "u8", 0)
    with pytest.raises(ValueError, match="nodata"):
        tiles.write(cells, str(tmp_path / "c"), 1 << 16 | 1, 3, 3, "u8", -1)


def test_damage_is_seen(spark, stored):
    _, path = stored
    blobs = spark.read.parquet(f"{path}/blobs")
    assert tiles.misfits(spark, path, "u16").count() == 0 and tiles.misfits(spark, path, "i16").count() == 4
    cut = blobs.withColumn("payload", F.expr("substring(payload, 1, length(payload) - 3)"))
    cut.write.parquet(f"{path}/cut/blobs")
    spark.read.parquet(f"{path}/index").write.parquet(f"{path}/cut/index")
    assert {r.code for r in tiles.misfits(spark, f"{path}/cut", "u16").collect()} == {"blob"}
    assert tiles.tampered(spark, f"{path}/cut").count() == 3


def test_an_index_is_committed_whole_or_not(spark, stored):
    _, path = stored
    index = spark.read.parquet(f"{path}/index")
    spark.read.parquet(f"{path}/blobs").limit(1).write.parquet(f"{path}/less/blobs")
    with pytest.raises(ValueError, match="missing"):
        tiles.commit(index, f"{path}/less")
    with pytest.raises(ValueError, match="repeated"):
        tiles.commit(index.unionByName(index), path)

"""Golden values and invariants of addressing, hashing and codecs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import adjacency, bits, codec, cube, documents, ids, mixing64, radial


def test_golden_cube_keys(spark):
    df = spark.createDataFrame([(1, 1, 3)], "face int, i long, j long")
    assert df.select(cube.key(F.col("face"), F.col("i"), F.col("j"), 2)).first()[0] == 0x2F00000000000000
    df = spark.createDataFrame([(4, 0, 0)], "face int, i long, j long")
    assert df.select(cube.key(F.col("face"), F.col("i"), F.col("j"), 2)).first()[0] == bits.signed(0x8100000000000000)


@pytest.mark.parametrize("level", [0, 1, 7, 30])
def test_keys_round_trip(spark, level):
    n = 1 << level
    rows = [(f, i, j) for f in range(6) for i in {0, n // 2, n - 1} for j in {0, n // 3, n - 1}]
    df = spark.createDataFrame(rows, "f int, a long, b long").withColumn("key", cube.key(F.col("f"), F.col("a"), F.col("b"), level))
    assert cube.decoded(df).where(~((F.col("face") == F.col("f")) & (F.col("i") == F.col("a")) & (F.col("j") == F.col("b")) & (F.col("level") == level))).count() == 0
    assert cube.decoded(df).where("level is null").count() == 0


def test_adjacency_is_involutive():
    table = {(f, e): (tf, te, flip) for f, e, tf, te, flip in adjacency.rows()}
    assert len(table) == 24
    for place, (face, edge, flip) in table.items():
        assert table[face, edge] == (*place, flip)


@pytest.mark.parametrize("level", [1, 3])
def test_neighbours_are_mutual_and_near(spark, level):
    n = 1 << level
    cells = spark.range(6 * n * n).selectExpr(f"cast(id div {n * n} as int) as face", f"id div {n} % {n} as i", f"id % {n} as j")
    around = {(r.face, r.i, r.j, r.nface, r.ni, r.nj) for r in adjacency.neighbours(cells, level).collect()}
    assert all((d, e, f, a, b, c) in around for a, b, c, d, e, f in around)
    center = {(r.face, r.i, r.j): (r.cx, r.cy, r.cz) for r in cube.with_center(cells, level).collect()}
    for a, b, c, d, e, f in around:
        assert math.dist(center[a, b, c], center[d, e, f]) < 2.5 / n


def test_cells_cover_the_sphere(spark):
    cells = spark.range(6 * 16).selectExpr("cast(id div 16 as int) as face", "id div 4 % 4 as i", "id % 4 as j")
    area = cube.with_measure(cells, 2).agg(F.sum("measure")).first()[0]
    assert abs(area - 4 * math.pi) < 1e-10


def test_centers_lie_in_their_cells(spark):
    cells = spark.range(6 * 64).selectExpr("cast(id div 64 as int) as f", "id div 8 % 8 as a", "id % 8 as b")
    at = cube.with_center(cells.selectExpr("f as face", "a as i", "b as j"), 3).select("face", "i", "j", "cx", "cy", "cz")
    back = cube.locate(at.selectExpr("face as f", "i as a", "j as b", "cx", "cy", "cz"), F.col("cx"), F.col("cy"), F.col("cz"), 3)
    assert back.where("f <> face or a <> i or b <> j").count() == 0


def test_no_direction_is_no_cell(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (float("nan"), 1.0, 0.0), (float("inf"), 1.0, 0.0), (None, 1.0, 0.0)], "x double, y double, z double")
    assert cube.locate(df, F.col("x"), F.col("y"), F.col("z"), 3).where("face is not null").count() == 0


def test_golden_radial_keys(spark):
    row = spark.range(1).select(radial.key(F.lit(5), 3).alias("k"), radial.level_of(F.lit(13)).alias("l"), radial.index_of(F.lit(13).cast("long")).alias("i"), radial.level_of(F.lit(1 << 31)).alias("bad")).first()
    assert (row.k, row.l, row.i, row.bad) == (13, 3, 5, None)


def test_golden_mixes(spark):
    df = spark.createDataFrame([(0, 0x1234, 2)], "z long, p long, q int")
    assert mixing64.with_mix64(df, "z", "m").first()["m"] == 0
    found = mixing64.with_detail_hash(df, 0xAF79B71D2DC87B60, "p", "q", "d").first()["d"]
    assert found == bits.signed(0xF052801925416CF6)


@pytest.mark.parametrize("factor", [0, 1, 3, 0xBF58476D1CE4E5B9, (1 << 64) - 1])
def test_products_wrap(spark, factor):
    values = [0, 1, -1, 123456789012345678, -(1 << 63), (1 << 63) - 1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", bits.mul64(F.col("v"), factor).alias("m"), bits.add64(F.col("v"), F.lit(bits.signed(factor))).alias("s")).collect()
    for r in got:
        assert r.m == bits.signed(r.v * factor % (1 << 64))
        assert r.s == bits.signed((r.v + factor) % (1 << 64))


def test_blake3_vectors():
    count = lambda n: bytes(k % 251 for k in range(n))
    want = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 3073: "7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3"}
    assert [d.hex() for d in codec.blake3([count(n) for n in want])] == list(want.values())


def test_golden_canonical_bytes():
    text = codec.canonical_json('{"z":-2,"a":"value"}')
    assert text == '{"a":"value","z":-2}'
    assert codec.blake3([text.encode()])[0].hex() == "94fb9220ca0ba188ac445ea362a38583d34863ce48434cee78233ce0fbb4f218"
    index = bytes.fromhex("01000101010000000103080000010000000000000000000000000010f9ffffffffffffff000000000000000000000000000000000000000000000000")
    assert codec.pack_index(*codec.unpack_index(index)) == index
    assert codec.unpack_index(index)[3] == [(0, 1 << 60, -7, None)]
    assert codec.pack_raster(np.array([[[1, 2]]]), "u16").hex() == "5659423101030000020001000100000001000200"


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{"a":{"b":1,"\\u0062":2}}', "[1.5]", "[9007199254740992]", "[NaN]", "{"])
def test_json_that_has_no_canonical_form(bad):
    with pytest.raises(ValueError):
        codec.canonical_json(bad)


def test_names_sort_by_utf16():
    assert codec.canonical_json('{"\\ufb33":1,"\\ud83d\\ude00":2}').index("\U0001f600") < 5


@pytest.mark.parametrize(("x", "text"), [(1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-0.0, "0"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (333333333.33333329, "333333333.3333333")])
def test_number_texts(x, text):
    assert codec.number_text(x) == text


def test_storage_codec():
    for n in (0, 1, 2, 255, 4097):
        data = bytes(k * 7 % 256 for k in range(n))
        assert codec.restore(codec.store(data)) == data
    with pytest.raises(ValueError):
        codec.restore(codec.store(bytes(1000)), 999)


def test_damaged_blobs_are_refused():
    good = codec.pack_raster(np.arange(6).reshape(1, 2, 3), "i32")
    assert codec.unpack_raster(good).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    for bad in (good[:-1], b"XXXX" + good[4:], good[:6] + b"\1" + good[7:], good[:8] + b"\0\0" + good[10:]):
        with pytest.raises(ValueError):
            codec.unpack_raster(bad)


def test_damaged_frames_are_refused():
    data = codec.store(bytes(range(256)) * 40)
    assert codec.restore(data) == bytes(range(256)) * 40
    for bad in (data[:-6], data[: len(data) // 2], data[:3], b"", data + b"x", data + data):
        with pytest.raises(ValueError):
            codec.restore(bad)


def test_json_that_has_no_canonical_form():
    for text, floats in (("1" * 400, True), ('"\\ud800"', False), ('{"\\udc00": 1}', True), ("1.5", False), ('{"a": 1, "\\u0061": 2}', False)):
        with pytest.raises(ValueError):
            codec.canonical_json(text, floats)


def test_indexes_of_tiles_only():
    entry = lambda level, key: [(level, key, 5, None)]
    assert codec.unpack_index(codec.pack_index(1 << 16 | 1, 1, 3, entry(3, 1 << 60)))[3] == entry(3, 1 << 60)
    assert codec.unpack_index(codec.pack_index(1 << 16 | 1, 2, 3, entry(5, 32 + 3)))[3] == entry(5, 35)
    for field, topology, tile, e in ((1, 1, 3, entry(3, 1 << 60)), (1 << 16, 1, 3, entry(3, 1 << 60)), (1 << 16 | 1, 3, 3, []), (1 << 16 | 1, 1, 31, []), (1 << 16 | 1, 1, 3, entry(4, 1 << 60)), (1 << 16 | 1, 1, 3, entry(3, 7 << 61 | 1 << 60)), (1 << 16 | 1, 2, 3, entry(5, 32 + 4)), (1 << 16 | 1, 2, 3, entry(31, 1))):
        with pytest.raises(ValueError):
            codec.pack_index(field, topology, tile, e)


def test_constants_as_bytes():
    assert codec.const_bytes(-2, "i16") == b"\xfe\xff" and codec.const_bytes(0x3F800000, "f32") == b"\x00\x00\x80?"
    with pytest.raises(ValueError):
        codec.const_bytes(256, "u8")


def test_addresses_and_seeds(spark):
    form = "kind string, ix long, iy long, iz long, slot long, system string, role int, ordinal long, name string"
    rows = [("system_seed", -1, 64, 0, 300, *[None] * 4), ("free_object", -(1 << 63), (1 << 63) - 1, 5, (1 << 32) - 1, *[None] * 4), ("fixture", *[None] * 7, "é"), ("body_in_system", *[None] * 4, "ab" * 16, 3, 200, None)]
    wrong = [("x", 1, 1, 1, 1, *[None] * 4), ("system_seed", 1, 1, 1, 1 << 32, *[None] * 4), ("fixture", *[None] * 7, ""), ("body_in_system", *[None] * 4, "AB" * 16, 3, 200, None)]
    df = spark.createDataFrame(rows + wrong, form)
    made = df.select(*df.columns, ids.address(*(F.col(c) for c in df.columns)).alias("address"))
    got = [r.address for r in made.collect()]
    assert got == ["0101800100ac02", "03ffffffffffffffffff01feffffffffffffffff010affffffff0f", "0402c3a9", "02" + "ab" * 16 + "03c801", None, None, None, None]
    back = ids.with_region(made.select("address"), "address").collect()
    assert [tuple(r)[1:] for r in back[:2]] == [r[:5] for r in rows[:2]] and all(r.kind is None for r in back[2:])
    bad = spark.createDataFrame([(x,) for x in ("01018001", "0101800100ac0200", "0101800100ac8200", "01", "", "0101800100ffffffff1f", "01zz")], "address string")
    assert all(r.kind is None for r in ids.with_region(bad, "address").collect())
    key = codec.derive_key("a test of seeds", [bytes(16) + b"body"])[0]
    seed = int.from_bytes(key[:8], "little", signed=True)
    sub = codec.derive_key("a test of seeds", [seed.to_bytes(8, "little", signed=True) + b"refine/height"])[0]
    at = spark.range(1).select(ids.seed(F.lit("00" * 16), "a test of seeds").alias("s")).withColumn("u", ids.subseed(F.col("s"), F.lit("refine/height"), "a test of seeds"))
    assert tuple(at.first()) == (seed, int.from_bytes(sub[:8], "little", signed=True))
    one = spark.range(1).select(ids.object_id(F.lit("11" * 32), F.lit("0402c3a9"), "a test of ids")).first()[0]
    assert one == "obj:" + codec.derive_key("a test of ids", [bytes([0x11] * 32) + bytes.fromhex("0402c3a9")])[0].hex()[:32]
    parts = spark.createDataFrame([("0x00010002",), ("0x00000001",), ("0x00010000",), ("0xABCDEF01",)], "t string").select(ids.field_parts(F.col("t")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in parts] == [(1, 2), None, None, None]


def test_documents(spark):
    fits = lambda v, s: documents.schema_error(v, s) is None
    assert fits({"a": 1}, {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False, "x-note": 1})
    assert not fits({"a": 1, "b": 2}, {"properties": {"a": {}}, "additionalProperties": False}) and not fits({}, {"required": ["a"]})
    assert not fits(True, {"type": "integer"}) and fits(2.5, {"type": ["null", "number"]}) and not fits(1, {"const": True}) and not fits(1, {"minimum": 0})
    assert fits([1, 2], {"items": {"enum": [1, 2]}}) and not fits([1, 3], {"items": {"enum": [1, 2]}}) and not fits({"a": {"b": "x"}}, {"additionalProperties": {"additionalProperties": {"type": "null"}}})
    docs = spark.createDataFrame([('{"a": {"path": "p", "hash": "h"}, "b": [[{"path": "q", "hash": "i", "c": {"path": "r", "hash": "j"}}]], "path": 1, "hash": "x"}',), ("{",), (None,)], "doc string")
    got = docs.select(documents.referenced("doc").alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in got] == [[("p", "h"), ("q", "i"), ("r", "j")], [], []]
    stored = spark.createDataFrame([('{"scale": "0.50", "deep": [{"offset": "-1e5"}]}',), ('{"deep": [{"offset": 1}]}',), ('{"scale": "-0.0"}',), ('{"scale": "01"}',)], "doc string")
    assert [r[0] for r in stored.select(documents.storage_error("doc")).collect()] == [None, "$.deep[0].offset", "$.scale", "$.scale"]
    params = spark.createDataFrame([('{"properties": {"d": {"x-reference": "domain"}, "e": {"type": "string"}}}',)], "doc string")
    assert params.select(documents.annotations(F.col("doc"))).first()[0] == {"d": "domain"}

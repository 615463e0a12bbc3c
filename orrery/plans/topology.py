"""Queries over cell addressing, neighbours, geometry and radial shells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import adjacency, cube, ids, radial
from orrery.plans import sql
from orrery.plans.inputs import cells, d1, d2
from orrery.session import kept, table

QUERIES: dict = {}
SQL: dict = {}
#: sin of the latitudes that bound the 15 degree bands
BANDS = [math.sin(math.radians(d)) for d in range(-75, 90, 15)]
EXTENT, EXT = 600000.0, "600000e0"


def query(oracle: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


def _cell(*more: str) -> list:
    return [F.col("face").cast("int").alias("face"), "i", "j", *more]


@query(f"WITH {sql.located(sql.D1, 6)} SELECT id, face, i, j FROM cells")
def cube_locate(spark, sf_dir):
    return cells(d1(spark, sf_dir), 6).select("id", *_cell())


@query(f"WITH {sql.located(sql.D2, 8)} SELECT face, count(*)::BIGINT AS n, sum(i)::BIGINT AS sum_i, sum(j)::BIGINT AS sum_j FROM cells GROUP BY face")
def cube_locate_bulk(spark, sf_dir):
    found = cells(d2(spark, sf_dir), 8)
    return found.groupBy(F.col("face").cast("int").alias("face")).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


@query(f"""WITH {sql.located(sql.D2, 4)}, w AS (SELECT face, i, j, count(*)::BIGINT AS n, avg(value) AS mean FROM cells GROUP BY ALL), {sql.measured("w", 4, "g")}
SELECT face, i, j, n, round(mean, 6) AS mean_value, round(measure, 9) AS weight FROM g""")
def cube_cell_summary(spark, sf_dir):
    found = cells(d2(spark, sf_dir), 4).groupBy("face", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return cube.with_measure(found, 4).select(*_cell("n", F.round("mean", 6).alias("mean_value"), F.round("measure", 9).alias("weight")))


@query(f"WITH {sql.located(sql.D1, 10)} SELECT id, {sql.key('face', 'i', 'j', '10')} AS key FROM cells")
def cube_key_morton(spark, sf_dir):
    return cells(d1(spark, sf_dir), 10).select("id", cube.key(F.col("face"), F.col("i"), F.col("j"), 10).alias("key"))


@query(f"""WITH {sql.located(sql.D1, 10)} SELECT id, 10 AS level, face, i, j FROM cells UNION ALL
SELECT * FROM (VALUES (-1::BIGINT, NULL::INT, NULL::INT, NULL::BIGINT, NULL::BIGINT), (-2, NULL, NULL, NULL, NULL), (-3, NULL, NULL, NULL, NULL), (-4, NULL, NULL, NULL, NULL))""")
def cube_key_decode(spark, sf_dir):
    """Keys back to cells; zero, the sign bit, an odd marker and face 7 are no keys."""
    keys = cells(d1(spark, sf_dir), 10).select("id", cube.key(F.col("face"), F.col("i"), F.col("j"), 10).alias("key"))
    bad = spark.createDataFrame([(-1, 0), (-2, -(1 << 63)), (-3, 2), (-4, -(1 << 60))], keys.schema)
    return cube.decoded(keys.unionByName(bad)).select("id", "level", *_cell())


@query(f"WITH {sql.located(sql.D1, 10)} SELECT id, {sql.key('face', 'i//2', 'j//2', '9')} AS parent, {sql.key('face', 'i//128', 'j//128', '3')} AS above FROM cells")
def cube_parent(spark, sf_dir):
    k = cube.key(F.col("face"), F.col("i"), F.col("j"), 10)
    return cells(d1(spark, sf_dir), 10).select("id", cube.ancestor(k, 9).alias("parent"), cube.ancestor(k, 3).alias("above"))


@query(f"WITH {sql.located(sql.D1, 5)} SELECT id, q, {sql.key('face', '2*i + q//2', '2*j + q%2', '6')} AS child FROM cells, (VALUES (0), (1), (2), (3)) AS t(q)".replace("t(q)", "qq(q)"))
def cube_children(spark, sf_dir):
    four = cells(d1(spark, sf_dir), 5).withColumn("q", F.explode(F.array(*map(F.lit, range(4)))))
    a, b = F.shiftright("q", 1), F.col("q").bitwiseAND(F.lit(1))
    return four.select("id", "q", cube.key(F.col("face"), F.col("i") * 2 + a, F.col("j") * 2 + b, 6).alias("child"))


@query(f"""WITH {sql.located(sql.D2, 4)}, w AS (SELECT DISTINCT face, i, j FROM cells), e AS (SELECT * FROM w, (VALUES (0), (1), (2), (3)) AS ee(edge)), {sql.stepped("e", 4, "g")}
SELECT face, i, j, edge, nface, ni, nj FROM g""")
def cube_neighbors(spark, sf_dir):
    found = adjacency.neighbours(cells(d2(spark, sf_dir), 4).select("face", "i", "j").distinct(), 4)
    return found.select(*_cell("edge", F.col("nface").cast("int").alias("nface"), "ni", "nj"))


@query(f"""WITH c AS (SELECT face::INT AS face, a::BIGINT AS i, b::BIGINT AS j FROM range(6) AS f(face), (VALUES (0), (7)) AS x(a), (VALUES (0), (7)) AS y(b)),
eu AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE 1 END AS edge FROM c), {sql.stepped("eu", 3, "us")},
ev AS (SELECT face, i, j, CASE WHEN j = 0 THEN 2 ELSE 3 END AS edge, edge AS ueedge, nface AS uface, ni AS ui, nj AS uj FROM us), {sql.stepped("ev", 3, "vs")}
SELECT face, i, j, uface, ui, uj, nface AS vface, ni AS vi, nj AS vj FROM vs""")
def cube_corner_stencil(spark, sf_dir):
    every = spark.range(6 * 64).selectExpr("cast(id div 64 as int) as face", "id div 8 % 8 as i", "id % 8 as j")
    return adjacency.corner_stencil(every, 3).select(*_cell(*(F.col(c).cast("int" if c.endswith("face") else "long").alias(c) for c in ("uface", "ui", "uj", "vface", "vi", "vj"))))


@query(f"""WITH {sql.located(sql.D2, 6)} SELECT DISTINCT {sql.key('face', 'i//8', 'j//8', '3')} AS tile, 8 AS edge, (i//8)*8 AS start_i, (j//8)*8 AS start_j,
i * 16777216 AS pos_i, j * 16777216 AS pos_j FROM cells""")
def cube_tile_layout(spark, sf_dir):
    found = cells(d2(spark, sf_dir), 6).select("face", "i", "j").distinct()
    start = lambda c: F.shiftleft(F.shiftright(c, 3), 3)
    return found.select(
        cube.tile_key(F.col("face"), F.col("i"), F.col("j"), 6, 3).alias("tile"), F.lit(8).alias("edge"), start("i").alias("start_i"), start("j").alias("start_j"),
        F.shiftleft("i", 24).alias("pos_i"), F.shiftleft("j", 24).alias("pos_j"),
    ).distinct()


@query(f"""WITH {sql.located(sql.D2, 5)}, w AS (SELECT DISTINCT face, i, j FROM cells), {sql.direction("w", [("c", "(i+0.5e0)/32e0", "(j+0.5e0)/32e0")], "g")}
SELECT face, i, j, round(cx, 9) + 0e0 AS cx, round(cy, 9) + 0e0 AS cy, round(cz, 9) + 0e0 AS cz FROM g""")
def cube_cell_center(spark, sf_dir):
    found = cube.with_center(cells(d2(spark, sf_dir), 5).select("face", "i", "j").distinct(), 5)
    return found.select(*_cell(*((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("cx", "cy", "cz"))))


_GRID = "c AS (SELECT (id // 64)::INT AS face, id // 8 % 8 AS i, id % 8 AS j FROM range(384) AS r(id))"


@query(f"WITH {_GRID}, {sql.measured('c', 3, 'g')} SELECT face, i, j, round(measure, 9) AS measure FROM g")
def cube_cell_measure(spark, sf_dir):
    every = spark.range(6 * 64).selectExpr("cast(id div 64 as int) as face", "id div 8 % 8 as i", "id % 8 as j")
    return cube.with_measure(every, 3).select(*_cell(F.round("measure", 9).alias("measure")))


@query(f"WITH {_GRID}, {sql.measured('c', 3, 'g')} SELECT round(sum(measure), 8) AS area, round(4*pi(), 8) AS sphere FROM g")
def cube_total_area(spark, sf_dir):
    every = spark.range(6 * 64).selectExpr("cast(id div 64 as int) as face", "id div 8 % 8 as i", "id % 8 as j")
    return cube.with_measure(every, 3).agg(F.round(F.sum("measure"), 8).alias("area"), F.round(F.lit(4 * math.pi), 8).alias("sphere"))


_BAND = " + ".join(f"(CASE WHEN dz >= {b!r} THEN 1 ELSE 0 END)" for b in BANDS)


@query(f"WITH {sql.located(sql.D2, 1)} SELECT ({_BAND})::INT AS band, count(*)::BIGINT AS n, round(avg(atan2(dz, sqrt(dx*dx + dy*dy))), 7) AS lat, round(avg(cos(atan2(dy, dx))), 7) AS cos_lon FROM cells GROUP BY 1")
def axial_latlon_bands(spark, sf_dir):
    points = cube.with_latlon(cube.normalised(d2(spark, sf_dir), F.col("x"), F.col("y"), F.col("z")))
    return points.groupBy(F.expr(_BAND).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 7).alias("lat"), F.round(F.avg(F.cos("lon")), 7).alias("cos_lon"))


_TOP = cube.subtree((1 << 61 | 0b10 << 59) | 1 << 58)


@query(f"WITH {sql.located(sql.D2, 9)} SELECT count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM cells WHERE face = 1 AND i >= 256 AND j < 256")
def subtree_filter(spark, sf_dir):
    """Cells below one cell of level 1, from a table stored in key order: the range of keys
    reaches the scan, which passes over files and row groups beyond it."""
    keyed = cells(d2(spark, sf_dir), 9).withColumn("key", cube.key(F.col("face"), F.col("i"), F.col("j"), 9))
    stored = kept(keyed.select("key", "value").repartitionByRange("key").sortWithinPartitions("key"), "cells")
    return stored.where(F.col("key").between(*_TOP)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {sql.located(sql.D1, 10)}, k AS (SELECT id, (id % 12)::INT AS level, i, CASE WHEN id % 5 = 0 THEN {sql.key('face', 'i', 'j', '10')} WHEN id % 5 = 1 THEN 0 ELSE {sql.key('face', 'i//16', 'j//16', '6')} END AS key,
x / sqrt(x*x + y*y + z*z) * CASE WHEN id % 3 = 0 THEN 1.000001e0 ELSE 1e0 END AS ux, y / sqrt(x*x + y*y + z*z) AS uy, z / sqrt(x*x + y*y + z*z) AS uz FROM cells)
SELECT id, abs(ux*ux + uy*uy + uz*uz - 1) <= 1e-12 AS is_unit, CASE WHEN id % 5 = 1 THEN false WHEN id % 5 = 0 THEN greatest(0, level - 3) = 10 ELSE greatest(0, level - 3) = 6 END AS is_tile,
(level = 9 AND i % 512 < 64) AS is_shell_tile, id % 4 = 1 AS is_extent FROM k""")
def key_validity(spark, sf_dir):
    """Directions, tile keys of both topologies and extents against their rules."""
    c = cells(d1(spark, sf_dir), 10).withColumn("level", (F.col("id") % 12).cast("int"))
    own = cube.key(F.col("face"), F.col("i"), F.col("j"), 10)
    c = c.withColumn("key", F.when(F.col("id") % 5 == 0, own).when(F.col("id") % 5 == 1, 0).otherwise(cube.ancestor(own, 6)))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    stretch = F.when(F.col("id") % 3 == 0, 1.000001).otherwise(1.0)
    extent = F.element_at(F.array(F.lit(0.0), F.lit(6.4e6), F.lit(-1.0), F.lit(1e200)), (F.col("id") % 4 + 1).cast("int"))
    shell = radial.is_tile_key(F.lit(512) + F.col("i") % 512, F.col("level"), 3)
    judged = cube.is_tile_key(c, "key", "level", 3)
    return judged.select("id", cube.is_unit(F.col("x") / size * stretch, F.col("y") / size, F.col("z") / size).alias("is_unit"), "is_tile", shell.alias("is_shell_tile"), radial.is_extent(extent).alias("is_extent"))


@query(f"WITH {sql.located(sql.D1, 6)} SELECT id, face, i, j FROM cells")
def axial_roundtrip(spark, sf_dir):
    """Directions to axial latitude and longitude, back again, and placed."""
    points = cube.with_latlon(cube.normalised(d1(spark, sf_dir), F.col("x"), F.col("y"), F.col("z")))
    back = cube.with_axial(points.select("id", "lat", "lon"), F.col("lat"), F.col("lon"))
    return cube.locate(back, F.col("dx"), F.col("dy"), F.col("dz"), 6).select("id", *_cell())


_ULEB = "array_to_string(list_transform(range(10), lambda k: CASE WHEN k > 0 AND {0} // (128::HUGEINT ** k)::HUGEINT = 0 THEN '' ELSE lpad(lower(to_hex((({0} // (128::HUGEINT ** k)::HUGEINT) % 128 + CASE WHEN {0} // (128::HUGEINT ** (k + 1))::HUGEINT > 0 THEN 128 ELSE 0 END)::BIGINT)), 2, '0') END), '')"


@query(f"""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 * o_custkey ELSE greatest(2 * o_custkey - 1, 0) END::HUGEINT AS x, (o_orderkey * 2)::HUGEINT AS y, floor(o_totalprice)::HUGEINT * 1000 AS s FROM orders)
SELECT id, '01' || {_ULEB.format('x')} || {_ULEB.format('y')} || '00' || {_ULEB.format('s')} AS address FROM a""")
def birth_addresses(spark, sf_dir):
    """Addresses of systems in a lattice: zigzagged coordinates and a slot, seven bits a byte."""
    o = table(spark, sf_dir, "orders")
    x = F.col("o_custkey") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    none = F.lit(None).cast("string")
    made = ids.address(F.lit("system_seed"), x, F.col("o_orderkey"), F.lit(0), F.floor("o_totalprice") * 1000, none, F.lit(None).cast("int"), F.lit(None).cast("long"), none)
    return o.select(F.col("o_orderkey").alias("id"), made.alias("address"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -o_custkey END AS ix, o_orderkey AS iy, 0::BIGINT AS iz, floor(o_totalprice)::BIGINT * 1000 AS slot FROM orders")
def address_decode(spark, sf_dir):
    """Those addresses read back."""
    back = ids.with_region(birth_addresses(spark, sf_dir), "address")
    return back.select("id", "ix", "iy", "iz", "slot")


_R = f"r AS (SELECT o_orderkey AS id, least(floor(o_totalprice / {EXT} * 1024e0), 1023)::BIGINT AS idx FROM orders)"


@query(f"WITH {_R} SELECT id, idx, 1024 + idx AS key, (1024 + idx) // 2 AS parent, (1024 + idx) * 2 AS first_child, 10 AS level FROM r")
def radial_locate(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), radial.locate(F.col("o_totalprice"), F.lit(EXTENT), 10).alias("idx"))
    k = found.withColumn("key", radial.key(F.col("idx"), 10))
    return k.select("id", radial.index_of(F.col("key")).alias("idx"), "key", F.shiftright("key", 1).alias("parent"), F.shiftleft("key", 1).alias("first_child"), radial.level_of(F.col("key")).alias("level"))


@query(f"""WITH {_R}, d AS (SELECT DISTINCT idx FROM r)
SELECT idx, round((idx + 0.5e0) / 1024e0 * {EXT}, 6) AS center, round({4 * math.pi / 3!r}e0 * {EXT} * {EXT} * {EXT} * ((idx+1)/1024e0 - idx/1024e0) *
(((idx+1)/1024e0)*((idx+1)/1024e0) + ((idx+1)/1024e0)*(idx/1024e0) + (idx/1024e0)*(idx/1024e0)) / 1e9, 3) AS measure_e9 FROM d""")
def radial_center_measure(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(radial.locate(F.col("o_totalprice"), F.lit(EXTENT), 10).alias("idx")).distinct()
    at, ext = F.col("idx"), F.lit(EXTENT)
    return found.select("idx", F.round(radial.center(at, ext, 10), 6).alias("center"), F.round(radial.measure(at, ext, 10) / 1e9, 3).alias("measure_e9"))


_SHELLS = f"{_R}, s AS (SELECT idx, count(*)::BIGINT AS n FROM r GROUP BY idx)"


@query(f"""WITH {_SHELLS} SELECT s.idx, s.n, a.n AS below, b.n AS above FROM s LEFT JOIN s a ON a.idx = greatest(s.idx - 1, 0) LEFT JOIN s b ON b.idx = least(s.idx + 1, 1023)""")
def radial_halo_clamped(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(radial.locate(F.col("o_totalprice"), F.lit(EXTENT), 10).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    out = found
    for name, by in (("below", -1), ("above", 1)):
        side = found.select(F.col("idx").alias("_at"), F.col("n").alias(name))
        out = out.withColumn("_at", radial.clamped(F.col("idx"), by, 10)).join(side, "_at", "left").drop("_at")
    return out.select("idx", "n", "below", "above")


_FIELD = f"f AS (SELECT least(floor(o_totalprice / {EXT} * 16e0), 15)::BIGINT AS idx, avg(o_totalprice) AS v FROM orders GROUP BY 1)"


@query(f"""WITH {_FIELD}, p AS (SELECT c_custkey AS id, abs(c_acctbal) / 10000e0 * 16e0 - 0.5e0 AS x FROM customer),
q AS (SELECT id, x, greatest(floor(x), 0)::BIGINT AS lo, least(floor(x) + 1, 15)::BIGINT AS hi, x - floor(x) AS w FROM p)
SELECT id, round(CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE a.v * (1 - w) + b.v * w END, 6) AS value FROM q LEFT JOIN f a ON a.idx = lo LEFT JOIN f b ON b.idx = hi""")
def radial_linear_sample(spark, sf_dir):
    """Linear between shell centres, nearest beyond the ends and beside missing shells."""
    field = table(spark, sf_dir, "orders").groupBy(radial.locate(F.col("o_totalprice"), F.lit(EXTENT), 4).alias("idx")).agg(F.avg("o_totalprice").alias("v"))
    x = F.abs("c_acctbal") / 10000.0 * 16.0 - 0.5
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x.alias("x"))
    points = points.withColumns({"lo": F.greatest(F.floor("x"), F.lit(0)), "hi": F.least(F.floor("x") + 1, F.lit(15)), "w": F.col("x") - F.floor("x")})
    for end in ("lo", "hi"):
        points = points.join(field.select(F.col("idx").alias(end), F.col("v").alias(f"{end}_v")), end, "left")
    both = F.col("lo_v") * (1 - F.col("w")) + F.col("hi_v") * F.col("w")
    return points.select("id", F.round(F.coalesce(both, "lo_v", "hi_v"), 6).alias("value"))

"""Queries over pyramids, statistics, time slices and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import adjacency, cube
from orrery.operators import grid, sampling
from orrery.plans import sql
from orrery.plans.inputs import cells, d1, d2
from orrery.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


def _face():
    return F.col("face").cast("int").alias("face")


_RAW = "floor((value - 1000e0) / 0.5e0 + 0.5e0)::BIGINT"


def _raw(spark, sf_dir, level):
    """Quantised values in cells; every 7th raw value is taken for missing."""
    found = cells(d2(spark, sf_dir), level).withColumn("raw", grid.quantised(F.col("value"), 0.5, 1000.0))
    return found.withColumn("raw", F.when(F.col("raw") % 7 != 0, F.col("raw")))


def _sql_raw(level: int) -> str:
    return f"{sql.located(sql.D2, level)}, q AS (SELECT *, CASE WHEN {_RAW} % 7 <> 0 THEN {_RAW} END AS raw FROM cells)"


@query(f"WITH {sql.located(sql.D2, 5)}, q AS (SELECT *, {_RAW} AS raw FROM cells) SELECT face, i, j, count(*)::BIGINT AS n, count(nullif(raw, 40000))::BIGINT AS valid, round(sum(CASE WHEN raw <> 40000 THEN raw::DOUBLE * 0.5e0 + 1000e0 END), 4) AS total FROM q GROUP BY ALL")
def grid_quantize_decode(spark, sf_dir):
    q = cells(d2(spark, sf_dir), 5).withColumn("raw", grid.quantised(F.col("value"), 0.5, 1000.0)).withColumn("v", grid.decoded(F.col("raw"), 0.5, 1000.0, 40000))
    return q.groupBy(_face(), "i", "j").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.round(F.sum("v"), 4).alias("total"))


def _pyramid(op: str, expression: str):
    @query(f"WITH {_sql_raw(6)} SELECT face, i // 2 AS i, j // 2 AS j, {expression} AS raw FROM q GROUP BY 1, 2, 3")
    def run(spark, sf_dir):
        return grid.pyramid(_raw(spark, sf_dir, 6), op).select(_face(), "i", "j", "raw")

    QUERIES[f"pyramid_{op}"] = QUERIES.pop("run")
    SQL[f"pyramid_{op}"] = SQL.pop("run")


_pyramid("mean", "floor((2 * sum(raw) + count(raw))::DOUBLE / (2 * count(raw)))::BIGINT")
_pyramid("min", "min(raw)")
_pyramid("max", "max(raw)")
_pyramid("sum", "sum(raw)::BIGINT")
_pyramid("rms", "floor(sqrt(sum(raw * raw)::DOUBLE / count(raw)) + 0.5e0)::BIGINT")


@query(f"""WITH {sql.located(sql.D2, 6)}, c AS (SELECT face, i // 2 AS i, j // 2 AS j, category, count(*) AS n FROM cells GROUP BY ALL)
SELECT face, i, j, category AS mode FROM c QUALIFY row_number() OVER (PARTITION BY face, i, j ORDER BY n DESC, category) = 1""")
def pyramid_mode(spark, sf_dir):
    up = cells(d2(spark, sf_dir), 6).withColumns({"i": F.shiftright("i", 1), "j": F.shiftright("j", 1)})
    return up.groupBy(_face(), "i", "j").agg(F.mode("category", True).alias("mode"))


_MEANS = "f AS (SELECT face, i, j, avg(value) AS value FROM cells GROUP BY face, i, j)"


def _field(spark, sf_dir, level):
    return cells(d2(spark, sf_dir), level).groupBy("face", "i", "j").agg(F.avg("value").alias("value"))


@query(f"""WITH {sql.located(sql.D2, 5)}, {_MEANS}, {sql.measured("f", 5, "g")} SELECT face, count(*)::BIGINT AS cells, round(sum(measure), 8) AS area, round(sum(value * measure) / sum(measure), 4) AS mean,
round(sum(value * value * measure) / sum(measure) - (sum(value * measure) / sum(measure)) * (sum(value * measure) / sum(measure)), 1) AS variance FROM g GROUP BY face""")
def stats_measure_weighted(spark, sf_dir):
    out = grid.weighted_stats(_field(spark, sf_dir, 5), 5, "value", ("face",))
    return out.select(_face(), "cells", F.round("area", 8).alias("area"), F.round("mean", 4).alias("mean"), F.round("variance", 1).alias("variance"))


@query(f"""WITH {sql.located(sql.D2, 5)}, {_MEANS}, k AS (SELECT *, least(floor((value - 0e0) / 100000e0 * 20e0), 19)::INT AS bin FROM f WHERE value BETWEEN 0 AND 100000), {sql.measured("k", 5, "g")}
SELECT bin, count(*)::BIGINT AS cells, round(sum(measure), 8) AS area FROM g GROUP BY bin""")
def histogram_weighted(spark, sf_dir):
    return grid.histogram(_field(spark, sf_dir, 5), 5, "value", 0.0, 100000.0, 20).select("bin", "cells", F.round("area", 8).alias("area"))


@query(f"""WITH {sql.located(sql.D2, 6)}, r AS (SELECT face, i, j, floor(avg(l_quantity) / 10)::BIGINT AS raw FROM cells GROUP BY face, i, j)
SELECT {sql.key('face', 'i//4', 'j//4', '4')} AS tile, count(*)::BIGINT AS cells, min(raw) = max(raw) AS is_const, CASE WHEN min(raw) = max(raw) THEN min(raw) END AS const_raw FROM r GROUP BY 1""")
def const_tile_detect(spark, sf_dir):
    r = cells(d2(spark, sf_dir), 6).groupBy("face", "i", "j").agg(F.floor(F.avg("l_quantity") / 10).alias("raw"))
    return grid.tiles(r, 6, 2)


_DAY = 86_400_000_000


@query(f"SELECT (((epoch_us(ts) - 1704067200000000) % {_DAY}) * 12 // {_DAY})::INT AS slice, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY 1, 2")
def periodic_slices(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = grid.time_slice(F.unix_micros(F.col("ts").cast("timestamp")), 1704067200000000, _DAY, 12)
    return e.groupBy(at.alias("slice"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"))


@query(f"""WITH s AS (SELECT event_type, (((epoch_us(ts) - 1704067200000000) % {_DAY}) * 12 // {_DAY})::INT AS slice, floor(avg(value) * 100 + 0.5e0)::BIGINT AS raw FROM events GROUP BY 1, 2)
SELECT event_type, floor((2 * sum(raw) + count(raw))::DOUBLE / (2 * count(raw)))::BIGINT AS mean, min(raw) AS low, max(raw) AS high, sum(raw)::BIGINT AS total, floor(sqrt(sum(raw * raw)::DOUBLE / count(raw)) + 0.5e0)::BIGINT AS rms,
(SELECT m.raw FROM s m WHERE m.event_type = s.event_type GROUP BY m.raw ORDER BY count(*) DESC, m.raw LIMIT 1) AS mode FROM s GROUP BY 1""")
def time_reduce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = grid.time_slice(F.unix_micros(F.col("ts").cast("timestamp")), 1704067200000000, _DAY, 12)
    s = e.groupBy("event_type", at.alias("slice")).agg(F.floor(F.avg("value") * 100 + 0.5).alias("raw"))
    return s.groupBy("event_type").agg(*(grid.reduced(op).alias(name) for op, name in (("mean", "mean"), ("min", "low"), ("max", "high"), ("sum", "total"), ("rms", "rms"), ("mode", "mode"))))


@query(f"WITH {sql.located(sql.D2, 4)}, {_MEANS}, {sql.located(sql.D1, 4, 'p')} SELECT p.id, round(f.value, 6) AS value FROM p LEFT JOIN f USING (face, i, j)")
def sample_nearest(spark, sf_dir):
    return sampling.nearest(d1(spark, sf_dir), _field(spark, sf_dir, 4), 4).select("id", F.round("value", 6).alias("value"))


@query(f"""WITH {sql.located(sql.D2, 4)}, {_MEANS}, {sql.located(sql.D1, 4, 'p')},
a AS (SELECT id, face, floor(s*16e0-0.5e0)::BIGINT AS i0, floor(t*16e0-0.5e0)::BIGINT AS j0, s*16e0-0.5e0-floor(s*16e0-0.5e0) AS fa, t*16e0-0.5e0-floor(t*16e0-0.5e0) AS fb FROM p),
b AS (SELECT id, face, i0 + pp AS gi, j0 + qq AS gj, (CASE WHEN pp = 1 THEN fa ELSE 1 - fa END) * (CASE WHEN qq = 1 THEN fb ELSE 1 - fb END) AS weight FROM a, (VALUES (0), (1)) AS x(pp), (VALUES (0), (1)) AS y(qq)),
c AS (SELECT *, CASE WHEN gi < 0 THEN 0 WHEN gi > 15 THEN 1 END AS eu, CASE WHEN gj < 0 THEN 2 WHEN gj > 15 THEN 3 END AS ev, least(greatest(gi, 0), 15) AS i, least(greatest(gj, 0), 15) AS j FROM b),
e AS (SELECT id, face, i, j, eu AS edge, weight / 2 AS w FROM c WHERE eu IS NOT NULL AND ev IS NOT NULL UNION ALL SELECT id, face, i, j, ev, weight / 2 FROM c WHERE eu IS NOT NULL AND ev IS NOT NULL
  UNION ALL SELECT id, face, i, j, coalesce(eu, ev), weight FROM c WHERE (eu IS NULL) <> (ev IS NULL)), {sql.stepped("e", 4, "g")},
st AS (SELECT id, nface AS face, ni AS i, nj AS j, w FROM g UNION ALL SELECT id, face, i, j, weight FROM c WHERE eu IS NULL AND ev IS NULL)
SELECT id, round(sum(w * f.value) / sum(CASE WHEN f.value IS NOT NULL THEN w END), 6) AS value, round(coalesce(sum(CASE WHEN f.value IS NOT NULL THEN w END), 0), 9) AS weight
FROM st LEFT JOIN f USING (face, i, j) GROUP BY id""")
def sample_bilinear(spark, sf_dir):
    out = sampling.bilinear(d1(spark, sf_dir), _field(spark, sf_dir, 4), 4)
    return out.select("id", F.round("value", 6).alias("value"), F.round("weight", 9).alias("weight"))


@query(f"""WITH {sql.located(sql.D2, 3)}, {_MEANS}, r AS (SELECT x - 1 AS gi, y - 1 AS gj, 0 AS face, x - 1 AS a, y + 3 AS b FROM range(6) AS xx(x), range(6) AS yy(y)),
k AS (SELECT *, CASE WHEN a < 0 THEN 0 WHEN a > 7 THEN 1 WHEN b < 0 THEN 2 WHEN b > 7 THEN 3 END AS edge, least(greatest(a, 0), 7) AS i, least(greatest(b, 0), 7) AS j FROM r WHERE (a BETWEEN 0 AND 7) OR (b BETWEEN 0 AND 7)),
e AS (SELECT * FROM k WHERE edge IS NOT NULL), {sql.stepped("e", 3, "g")},
w AS (SELECT gi, gj, face, i, j FROM k WHERE edge IS NULL UNION ALL SELECT gi, gj, nface, ni, nj FROM g) SELECT gi, gj, round(f.value, 6) AS value FROM w JOIN f USING (face, i, j)""")
def tile_with_halo(spark, sf_dir):
    return sampling.tile_with_halo(_field(spark, sf_dir, 3), 0, 0, 1, 3, 2).select("gi", "gj", F.round("value", 6).alias("value"))


@query(f"""WITH {sql.located(sql.D2, 4)}, f AS (SELECT face, i, j, avg(value) AS price, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM cells GROUP BY face, i, j), {sql.located(sql.D1, 4, 'p')}
SELECT id, round(price, 6) AS price, round(quantity, 6) AS quantity, round(discount, 9) AS discount FROM p LEFT JOIN f USING (face, i, j)""")
def inspect_point(spark, sf_dir):
    """All fields of the cells that hold the points."""
    f = cells(d2(spark, sf_dir), 4).groupBy("face", "i", "j").agg(F.avg("value").alias("price"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    points = cells(d1(spark, sf_dir), 4)
    return points.join(f, ["face", "i", "j"], "left").select("id", F.round("price", 6).alias("price"), F.round("quantity", 6).alias("quantity"), F.round("discount", 9).alias("discount"))


@query(f"""WITH {sql.located(sql.D2, 5)}, {_MEANS}, {sql.measured("f", 5, "g")} SELECT CASE WHEN value > 40000 THEN 'land' ELSE 'ocean' END AS class, count(*)::BIGINT AS cells, round(sum(measure), 8) AS area FROM g GROUP BY 1""")
def land_ocean_partition(spark, sf_dir):
    """Cells above a level surface and the others, with their areas."""
    f = cube.with_measure(_field(spark, sf_dir, 5), 5)
    return f.groupBy(F.when(F.col("value") > 40000, "land").otherwise("ocean").alias("class")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("measure"), 8).alias("area"))


@query(f"""WITH {sql.located(sql.D2, 4)},
k AS (SELECT face, {sql.key('face', 'i//8', 'j//8', '1')} AS key1, {sql.key('face', 'i//2', 'j//2', '3')} AS key3, category, value FROM cells)
SELECT face, key1, key3, category, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM k GROUP BY ROLLUP (face, key1, key3, category)""")
def level_rollup(spark, sf_dir):
    """Totals at every prefix of the cells' keys at once."""
    c = cells(d2(spark, sf_dir), 4).withColumn("key", cube.key(F.col("face"), F.col("i"), F.col("j"), 4))
    k = c.select(_face(), cube.ancestor(F.col("key"), 1).alias("key1"), cube.ancestor(F.col("key"), 3).alias("key3"), "category", "value")
    return k.rollup("face", "key1", "key3", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {sql.located(sql.D2, 6)},
{", ".join(f"l{k} AS (SELECT {k} AS level, {sql.key('face', f'i//{1 << (6 - k)}', f'j//{1 << (6 - k)}', str(k))} AS key, floor(avg(value))::BIGINT AS raw FROM cells WHERE l_orderkey % {1 + 9 * (k == 6)} = 0 GROUP BY 2)" for k in (2, 4, 6))},
f AS (SELECT * FROM l2 UNION ALL SELECT * FROM l4 UNION ALL SELECT * FROM l6), {sql.located(sql.D1, 6, 'p')},
a AS ({" UNION ALL ".join(f"SELECT id, {k} AS level, {sql.key('face', f'i//{1 << (6 - k)}', f'j//{1 << (6 - k)}', str(k))} AS key FROM p" for k in (2, 4, 6))}),
m AS (SELECT id, max((f.level, f.key, f.raw)) AS b FROM a JOIN f USING (level, key) GROUP BY id)
SELECT p.id, b[3] * 0.5e0 AS value, b[3] AS raw, b[1] AS level_used, b[2] AS key, CASE WHEN b[1] = 6 THEN 'native' WHEN b[1] IS NOT NULL THEN 'pyramid' END AS source FROM p LEFT JOIN m ON p.id = m.id""")
def sample_finest(spark, sf_dir):
    """The finest stored cell above each point, of a field that is sparse at its native level."""
    at = cells(d2(spark, sf_dir), 6).withColumn("own", cube.key(F.col("face"), F.col("i"), F.col("j"), 6))
    stored = None
    for level in (2, 4, 6):
        some = at.where("l_orderkey % 10 = 0") if level == 6 else at
        one = some.groupBy(cube.ancestor(F.col("own"), level).alias("key")).agg(F.floor(F.avg("value")).alias("raw"))
        one = one.select(F.lit(level).alias("level"), "key", "raw", grid.decoded(F.col("raw"), 0.5, 0.0).alias("value"))
        stored = one if stored is None else stored.unionByName(one)
    return sampling.finest(d1(spark, sf_dir), stored, 6)


@query(f"""WITH {sql.located(sql.D2, 5)}, {_MEANS}, e AS (SELECT face, i, j, value, edge FROM f, (VALUES (0), (1), (2), (3)) AS ee(edge)), {sql.stepped("e", 5, "g")}
SELECT g.face <> nface AS seam, count(*)::BIGINT AS pairs, round(avg(abs(f.value - g.value)), 4) AS mean_step, round(max(abs(f.value - g.value)), 4) AS max_step
FROM g JOIN f ON f.face = nface AND f.i = ni AND f.j = nj GROUP BY 1""")
def seam_statistics(spark, sf_dir):
    """Steps between adjacent cells, across the cube's seams and inside its faces."""
    f = _field(spark, sf_dir, 5)
    other = f.select(F.col("face").alias("nface"), F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("value").alias("other"))
    met = adjacency.neighbours(f, 5).join(other, ["nface", "ni", "nj"])
    step = F.abs(F.col("other") - F.col("value"))
    return met.groupBy((F.col("face") != F.col("nface")).alias("seam")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(step), 4).alias("mean_step"), F.round(F.max(step), 4).alias("max_step"))


@query(f"WITH {sql.located(sql.D2, 5)}, {_MEANS} SELECT face, i, j, round(value, 6) AS value FROM f ORDER BY value DESC, face, i, j LIMIT 20")
def highest_cells(spark, sf_dir):
    """A top-k report: the 20 highest cells."""
    top = _field(spark, sf_dir, 5).orderBy(F.desc("value"), "face", "i", "j").limit(20)
    return top.select(_face(), "i", "j", F.round("value", 6).alias("value"))


@query(f"""WITH {sql.located(sql.D2, 5)}, {_MEANS}, e AS (SELECT face, i, j, value, edge FROM f, (VALUES (0), (1), (2), (3)) AS ee(edge)), {sql.stepped("e", 5, "g")}
SELECT g.face, g.i, g.j, round(avg(abs(f.value - g.value)), 6) AS roughness, count(*)::BIGINT AS around FROM g JOIN f ON f.face = nface AND f.i = ni AND f.j = nj GROUP BY g.face, g.i, g.j""")
def neighbour_roughness(spark, sf_dir):
    """Mean difference to the adjacent cells, across face edges as well."""
    f = _field(spark, sf_dir, 5)
    around = adjacency.neighbours(f, 5)
    other = f.select(F.col("face").alias("nface"), F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("value").alias("other"))
    met = around.join(other, ["nface", "ni", "nj"])
    return met.groupBy(_face(), "i", "j").agg(F.round(F.avg(F.abs(F.col("other") - F.col("value"))), 6).alias("roughness"), F.count(F.lit(1)).alias("around"))

"""Queries over cells below the stored level: detail, inheritance and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import cube
from orrery.functions.mixing64 import GOLDEN
from orrery.operators import states
from orrery.plans import sql
from orrery.plans.inputs import cells, d2

QUERIES: dict = {}
SQL: dict = {}
SEED, FIRST, RATIO, LIMIT = 81985529216486895, 45875, 40000, 40000


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


#: name, edge offsets, as the twins' rows
_SIDES = "(VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in states.SIDES.items()) + ") AS o(side, di, dj)"
_NATIVE = "f AS (SELECT face, i, j, floor(avg(value))::BIGINT AS p FROM cells GROUP BY face, i, j)"
#: CTEs: the neighbours' values w, e, s, n, sw, se, nw, ne of every cell of f, as t
_AROUND = f"""
a AS (SELECT face, i, j, side, di, dj, i + di AS gi, j + dj AS gj FROM f, {_SIDES}),
b AS (SELECT *, CASE WHEN gi < 0 THEN 0 WHEN gi > 31 THEN 1 END AS eu, CASE WHEN gj < 0 THEN 2 WHEN gj > 31 THEN 3 END AS ev FROM a),
c AS (SELECT face AS oface, i AS oi, j AS oj, side, eu, ev, face, least(greatest(gi, 0), 31) AS i, least(greatest(gj, 0), 31) AS j FROM b),
x AS (SELECT *, eu AS edge FROM c WHERE eu IS NOT NULL UNION ALL SELECT *, ev FROM c WHERE ev IS NOT NULL), {sql.stepped("x", 5, "g")},
n AS (SELECT oface, oi, oj, side, nface AS face, ni AS i, nj AS j FROM g UNION ALL SELECT oface, oi, oj, side, face, i, j FROM c WHERE eu IS NULL AND ev IS NULL),
v AS (SELECT oface, oi, oj, side, floor(sum(f.p)::DOUBLE / count(*))::BIGINT AS v FROM n JOIN f USING (face, i, j) GROUP BY ALL),
t AS (SELECT f.face, f.i, f.j, f.p, {", ".join(f"coalesce(max(v) FILTER (side = '{k}'), f.p) AS {k}" for k in states.SIDES)},
  min(least(v, f.p)) AS low, max(greatest(v, f.p)) AS high FROM f LEFT JOIN v ON oface = f.face AND oi = f.i AND oj = f.j GROUP BY f.face, f.i, f.j, f.p)"""
_Q = range(4)
_I = ["9 * p + 3 * w + 3 * s + sw", "9 * p + 3 * w + 3 * n + nw", "9 * p + 3 * e + 3 * s + se", "9 * p + 3 * e + 3 * n + ne"]


def _sum(name: str) -> str:
    return "(" + " + ".join(f"{name}{q}" for q in _Q) + ")"


def _floor(x: str, by: int) -> str:
    return f"floor(({x})::DOUBLE / {by})::BIGINT"


def _each(form) -> str:
    return ", ".join(form(q) for q in _Q)


def _zero(source: str, to: str) -> str:
    total = _sum(source)
    return _each(lambda q: f"{source}{q} - {_floor(total, 4)} - CASE WHEN {total} - 4 * {_floor(total, 4)} > {q} THEN 1 ELSE 0 END AS {to}{q}")


def _detail() -> str:
    """CTEs: t with the integers h0 to h3 of the children's hashes, as h."""
    out, last = [], "t1"
    for q in _Q:
        step = q * GOLDEN % (1 << 64)
        out.append(sql.mixed("key", f"parent{q}_", last, SEED))
        out.append(f"child{q} AS (SELECT * EXCLUDE (m), (m + {step}::UHUGEINT) % 18446744073709551616::UHUGEINT AS y FROM parent{q}_)")
        out.append(sql.mixed("y", f"hash{q}_", f"child{q}"))
        out.append(f"detail{q} AS (SELECT * EXCLUDE (m, y), (m::UBIGINT >> 40)::BIGINT - 8388608 AS h{q} FROM hash{q}_)")
        last = f"detail{q}"
    return ",\n".join(out) + f",\nh AS (SELECT * FROM {last})"


_CHILDREN = f"""WITH {sql.located(sql.D2, 5)}, {_NATIVE}, {_AROUND},
t1 AS (SELECT *, {sql.key('face', 'i', 'j', '5')} AS key, ((p % 1000) * {FIRST}) // 65536 AS amplitude, {_each(lambda q: f"{_I[q]} AS i{q}")} FROM t),
{_detail()},
j1 AS (SELECT *, 64 * p - {_sum('i')} AS c FROM h),
j2 AS (SELECT *, {_each(lambda q: f"i{q} + {_floor('c', 4)} + CASE WHEN c - 4 * {_floor('c', 4)} > {q} THEN 1 ELSE 0 END AS j{q}")} FROM j1),
j3 AS (SELECT *, {_each(lambda q: f"{_floor(f'j{q}', 16)} AS b{q}, j{q} - 16 * {_floor(f'j{q}', 16)} AS r{q}")}, {_zero('h', 'd')} FROM j2),
j4 AS (SELECT *, 4 * p - {_sum('b')} AS rest, {_each(lambda q: f"floor(d{q}::DOUBLE * amplitude / 8388608)::BIGINT AS e{q}")} FROM j3),
j5 AS (SELECT *, {_zero('e', 'z')}, {_each(lambda q: " + ".join(f"(r{o} > r{q} OR ({'true' if o < q else 'false'} AND r{o} = r{q}))::INT" for o in _Q if o != q) + f" AS a{q}")} FROM j4),
kids AS ({" UNION ALL ".join(f"SELECT face, i, j, p, low, high, {q} AS q, b{q} + CASE WHEN a{q} < rest THEN 1 ELSE 0 END + z{q} AS child FROM j5" for q in _Q)})"""


def _native(spark, sf_dir):
    return cells(d2(spark, sf_dir), 5).groupBy("face", "i", "j").agg(F.floor(F.avg("value")).alias("p"))


def _children(spark, sf_dir):
    f = states.with_neighbours(_native(spark, sf_dir), 5)
    near = [F.coalesce(k, "p") for k in states.SIDES]
    f = f.withColumns({"key": cube.key(F.col("face"), F.col("i"), F.col("j"), 5), "amplitude": states.amplitude(F.col("p") % 1000, FIRST, RATIO, 1)})
    low, high = F.least("p", *near), F.greatest("p", *near)
    return states.refined(f, SEED), f.select("face", "i", "j", low.alias("low"), high.alias("high"))


@query(f"{_CHILDREN} SELECT face, i, j, p, q, child FROM kids")
def refine_children(spark, sf_dir):
    """Children below the stored level, across the cube's edges; their sums are four times
    their parents."""
    return _children(spark, sf_dir)[0].withColumn("face", F.col("face").cast("int"))


@query(f"""{_CHILDREN}, o AS (SELECT *, low < {LIMIT} AND high >= {LIMIT} AS boundary FROM kids),
r AS (SELECT *, CASE WHEN boundary THEN child WHEN p >= {LIMIT} THEN greatest(child, {LIMIT}) ELSE least(child, {LIMIT - 1}) END AS output FROM o)
SELECT boundary, count(*)::BIGINT AS children, count(*) FILTER (output <> child) AS guarded, sum(output)::BIGINT AS total FROM r GROUP BY boundary""")
def refine_guard(spark, sf_dir):
    """Children kept on their parents' side of a threshold, and how often that took effect."""
    kids, around = _children(spark, sf_dir)
    out = states.guarded(kids.join(around, ["face", "i", "j"]), LIMIT)
    return out.groupBy("boundary").agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("output") != F.col("child")).alias("guarded"), F.sum("output").alias("total"))


@query(f"""WITH {sql.located(sql.D2, 7)}, n AS (SELECT face, i // 8 AS i, j // 8 AS j, min(category) AS label FROM cells GROUP BY 1, 2, 3)
SELECT c.l_orderkey AS id, c.face, c.i, c.j, label FROM cells c JOIN n ON n.face = c.face AND n.i = c.i // 8 AND n.j = c.j // 8""")
def refine_inherit(spark, sf_dir):
    """Categories three levels below the stored one: the native ancestor's."""
    deep = cells(d2(spark, sf_dir), 7).select(F.col("l_orderkey").alias("id"), F.col("face").cast("int").alias("face"), "i", "j", "category")
    native = deep.groupBy("face", F.shiftright("i", 3).alias("i"), F.shiftright("j", 3).alias("j")).agg(F.min("category").alias("label"))
    return states.inherited(deep.drop("category"), native, 3, "label")

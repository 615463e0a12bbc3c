"""DuckDB snippets from which the queries' SQL twins are put together."""

from __future__ import annotations

from orrery.functions import adjacency, mixing64
from orrery.functions.cube import FACE_UV, FACE_XYZ

D1 = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"
D2 = (
    "SELECT l_quantity - 25.5e0 AS x, l_extendedprice / 1000e0 - 50e0 AS y, l_discount * 100e0 - 5.05e0 + l_tax AS z,"
    " l_extendedprice AS value, l_returnflag AS category, l_orderkey, l_quantity, l_discount FROM lineitem"
)
ADJACENCY = "(VALUES " + ", ".join(f"({f}, {e}, {tf}, {te}, {str(flip).lower()})" for f, e, tf, te, flip in adjacency.rows()) + ") AS adj(aface, aedge, to_face, to_edge, flip)"


def _case(forms: dict, at: int, names: dict[str, str]) -> str:
    return "CASE face " + " ".join(f"WHEN {f} THEN {''.join(names.get(c, c) for c in row[at]) if names else row[at]}" for f, row in forms.items()) + " END"


def located(points: str, level: int, name: str = "cells") -> str:
    """CTEs that end in ``name``: the points with dx, dy, dz, face, s, t, i, j."""
    n = float(1 << level)
    d = {"x": "dx", "y": "dy", "z": "dz"}
    warp = "CASE WHEN {0} >= 0 THEN 0.5e0*sqrt(1e0+3e0*{0}) ELSE 1e0-0.5e0*sqrt(1e0-3e0*{0}) END"
    return f"""{name}_a AS (SELECT *, greatest(abs(x), abs(y), abs(z)) AS m FROM ({points})),
{name}_b AS (SELECT *, x/m AS x1, y/m AS y1, z/m AS z1 FROM {name}_a),
{name}_c AS (SELECT *, sqrt(x1*x1 + y1*y1 + z1*z1) AS nn FROM {name}_b),
{name}_d AS (SELECT *, x1/nn AS dx, y1/nn AS dy, z1/nn AS dz FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN CASE WHEN dx >= 0 THEN 0 ELSE 3 END
  WHEN abs(dy) >= abs(dz) THEN CASE WHEN dy >= 0 THEN 1 ELSE 4 END ELSE CASE WHEN dz >= 0 THEN 2 ELSE 5 END END AS face FROM {name}_d),
{name}_f AS (SELECT *, {_case(FACE_UV, 0, d)} AS u, {_case(FACE_UV, 1, d)} AS v FROM {name}_e),
{name}_g AS (SELECT *, {warp.format("u")} AS s, {warp.format("v")} AS t FROM {name}_f),
{name} AS (SELECT *, least(floor(s*{n}), {n}-1)::BIGINT AS i, least(floor(t*{n}), {n}-1)::BIGINT AS j FROM {name}_g)"""


def key(face: str, i: str, j: str, level: str) -> str:
    """The signed key, by sums of powers of two in wide integers."""
    path = f"list_sum(list_transform(range({level}), lambda b: ((({i}) // (1::BIGINT << b)) % 2)::HUGEINT * (1::HUGEINT << (2*b+1)::INT) + ((({j}) // (1::BIGINT << b)) % 2)::HUGEINT * (1::HUGEINT << (2*b)::INT)))"
    whole = f"(({face})::HUGEINT * 2305843009213693952 + coalesce({path}, 0)::HUGEINT * (1::HUGEINT << (61 - 2*({level}))::INT) + (1::HUGEINT << (60 - 2*({level}))::INT))"
    return f"(CASE WHEN {whole} >= 9223372036854775808 THEN {whole} - 18446744073709551616 ELSE {whole} END)::BIGINT"


def direction(source: str, points: list[tuple[str, str, str]], name: str) -> str:
    """CTEs: ``source`` rows (face, ...) with unit vectors <p>x, <p>y, <p>z at (s, t)."""
    bend = "CASE WHEN {0} >= 0.5e0 THEN (4e0*{0}*{0}-1e0)/3e0 ELSE (1e0-4e0*(1e0-{0})*(1e0-{0}))/3e0 END"
    out, last = [], source
    for p, s, t in points:
        own = f"{name}_{p}"
        xyz = [_case(FACE_XYZ, k, {"u": f"{p}u", "v": f"{p}v"}) for k in range(3)]
        out += [
            f"{own}1 AS (SELECT *, {s} AS {p}s, {t} AS {p}t FROM {last})",
            f"{own}2 AS (SELECT *, {bend.format(p + 's')} AS {p}u, {bend.format(p + 't')} AS {p}v FROM {own}1)",
            f"{own}3 AS (SELECT *, {xyz[0]} AS {p}x0, {xyz[1]} AS {p}y0, {xyz[2]} AS {p}z0 FROM {own}2)",
            f"{own} AS (SELECT *, {p}x0/sqrt({p}x0*{p}x0+{p}y0*{p}y0+{p}z0*{p}z0) AS {p}x, {p}y0/sqrt({p}x0*{p}x0+{p}y0*{p}y0+{p}z0*{p}z0) AS {p}y, {p}z0/sqrt({p}x0*{p}x0+{p}y0*{p}y0+{p}z0*{p}z0) AS {p}z FROM {own}3)",
        ]
        last = own
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {last})"])


def measured(source: str, level: int, name: str) -> str:
    """CTEs: ``source`` rows (face, i, j) with their solid angle ``measure``."""
    n = float(1 << level)
    corners = [(p, f"(i + {a})/{n}", f"(j + {b})/{n}") for p, a, b in (("p", 0, 0), ("q", 1, 0), ("r", 1, 1), ("w", 0, 1))]
    dot = lambda a, b: f"({a}x*{b}x + {a}y*{b}y + {a}z*{b}z)"
    tri = lambda a, b, c: (
        f"2e0*atan2(abs({a}x*({b}y*{c}z - {b}z*{c}y) + {a}y*({b}z*{c}x - {b}x*{c}z) + {a}z*({b}x*{c}y - {b}y*{c}x)), 1e0 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)})"
    )
    return direction(source, corners, f"{name}_d") + f",\n{name} AS (SELECT *, {tri('p', 'q', 'r')} + {tri('p', 'r', 'w')} AS measure FROM {name}_d)"


def stepped(source: str, level: int, name: str) -> str:
    """CTEs: ``source`` rows (face, i, j, edge) with the cell beyond the edge."""
    n = 1 << level
    return f"""{name}_a AS (SELECT *, CASE edge WHEN 0 THEN i > 0 WHEN 1 THEN i < {n - 1} WHEN 2 THEN j > 0 ELSE j < {n - 1} END AS inside,
  CASE WHEN edge < 2 THEN j ELSE i END AS along0 FROM {source} JOIN {ADJACENCY} ON aface = face AND aedge = edge),
{name}_b AS (SELECT *, CASE WHEN flip THEN {n - 1} - along0 ELSE along0 END AS along, CASE WHEN to_edge % 2 = 0 THEN 0 ELSE {n - 1} END AS rim FROM {name}_a),
{name} AS (SELECT * EXCLUDE (aface, aedge, to_face, to_edge, flip, inside, along0, along, rim), CASE WHEN inside THEN face ELSE to_face END AS nface,
  (CASE WHEN inside THEN i + CASE edge WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END WHEN to_edge < 2 THEN rim ELSE along END)::BIGINT AS ni,
  (CASE WHEN inside THEN j + CASE edge WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END WHEN to_edge < 2 THEN along ELSE rim END)::BIGINT AS nj FROM {name}_b)"""


def mixed(x: str, name: str, source: str, seed: int | None = None) -> str:
    """CTEs: column x of ``source``, modulo 2^64 and under xor with a seed, through the
    finaliser, as <name>.m; wide integers hold the unsigned steps."""
    m = "18446744073709551616::UHUGEINT"
    first = f"(CASE WHEN {x}::HUGEINT < 0 THEN {x}::HUGEINT + 18446744073709551616 ELSE {x}::HUGEINT END)::UBIGINT"
    first = first if seed is None else f"xor({first}, {seed}::UBIGINT)"
    out = [f"{name}0 AS (SELECT *, {first}::UHUGEINT AS m0 FROM {source})"]
    for k, (shift, factor) in enumerate(mixing64.STEPS):
        step = f"xor(m{k}::UBIGINT, (m{k}::UBIGINT >> {shift}))"
        if factor:
            # the product of two 64-bit numbers by halves, so that it stays in 128 bits
            lo, hi = factor & 0xFFFFFFFF, factor >> 32
            product = f"((half_ * {lo}::UHUGEINT + ((half_ * {hi}::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT) % {m})"
            out.append(f"{name}{k + 1} AS (SELECT * EXCLUDE (half_), {product} AS m{k + 1} FROM (SELECT *, {step}::UHUGEINT AS half_ FROM {name}{k}))")
        else:
            out.append(f"{name} AS (SELECT * EXCLUDE (m0, m1, m2), {step}::UHUGEINT AS m FROM {name}{k})")
    return ",\n".join(out)

"""As-of joins, memberships, exact frames and refinement of integer fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import adjacency
from orrery.functions.mixing64 import with_detail_hashes
from orrery.operators.grid import floor_div


def as_of(queries: DataFrame, states: DataFrame, by: str, at: str, values: list[str], slot: Column | None = None) -> DataFrame:
    """``queries`` with the latest state at or before ``at`` for the same ``by``.

    Both sides are one stream in time order; the last state seen is carried forward, so a
    key is sorted once and no pair of rows is formed. Of states at the same time the one
    with the greatest values counts. ``slot``, a rising integer function of ``at`` (an hour, a
    day), cuts the stream of each key: slots are sorted on their own, and only each slot's
    last state goes on to the later ones, so a key with a third of all rows is no one task."""
    blank = [F.lit(None).cast(states.schema[v].dataType).alias(v) for v in values]
    left = queries.select("*", *blank, F.lit(1).alias("_side"), F.struct(*queries.columns).alias("_row"))
    right = states.select(by, at, *values, F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both = left.select(by, at, *values, "_side", "_row").unionByName(right)
    both = both.withColumn("_state", F.when(F.col("_side") == 0, F.struct(F.col(at).alias("_t"), *values)))
    both = both.withColumn("_slot", F.lit(0) if slot is None else slot)
    seen = Window.partitionBy(by, "_slot").orderBy(at, "_side", *values).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_state", F.last("_state", ignorenulls=True).over(seen)).where("_side = 1")
    if slot is not None:
        # a row a key and slot: the last state of the slots before
        ends = both.groupBy(by, "_slot").agg(F.max("_state").alias("_end"))
        earlier = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(F.col(by).alias("_by"), F.col("_slot").alias("_at"), F.last("_end", ignorenulls=True).over(earlier).alias("_end"))
        met = carried[by].eqNullSafe(ends["_by"]) & carried["_slot"].eqNullSafe(ends["_at"])
        carried = carried.join(ends, met).withColumn("_state", F.coalesce("_state", "_end"))
    return carried.select("_row.*", F.col("_state._t").alias("state_at"), *(F.col(f"_state.{v}").alias(v) for v in values))


def members(events: DataFrame, group: str, who: str, at: str, joins: Column, leaves: Column) -> DataFrame:
    """(group, members): who has joined and not left since, by each one's last event."""
    kept = events.where(joins | leaves).groupBy(group, who).agg(F.max_by(F.struct(joins.alias("inside")), F.struct(at, joins)).alias("_last"))
    return kept.where("_last.inside").groupBy(group).agg(F.count(F.lit(1)).alias("members"))


def zero_sum(names: list[str]) -> list[Column]:
    """Four integer columns less their floored mean, the first ones less the remainder: sum zero."""
    total = "(" + " + ".join(names) + ")"
    mean = f"({total} - pmod({total}, 4L)) div 4L"
    return [F.expr(f"{x} - {mean} - cast(pmod({total}, 4L) > {q} as long)") for q, x in enumerate(names)]


#: The offsets of the eight cells around a cell, by name.
SIDES = {"w": (-1, 0), "e": (1, 0), "s": (0, -1), "n": (0, 1), "sw": (-1, -1), "se": (1, -1), "nw": (-1, 1), "ne": (1, 1)}


def with_neighbours(cells: DataFrame, level: int, value: str = "p") -> DataFrame:
    """Adds the values of the eight cells around each cell (face, i, j), across face edges as
    well; at a cube's corner the floored mean of the two beside it, null where none is known.

    Every cell asks for its neighbours' values in one equi-join and gets them in one grouping."""
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.lit(a).alias("di"), F.lit(b).alias("dj")) for k, (a, b) in SIDES.items()))
    asked = adjacency.around(cells.select("face", "i", "j", F.inline(sides)), level)
    known = cells.select(F.col("face").alias("tface"), F.col("i").alias("ti"), F.col("j").alias("tj"), F.col(value).alias("_v"))
    met = asked.join(known, ["tface", "ti", "tj"])
    of = lambda k: F.when(F.col("side") == k, F.col("_v"))
    around = met.groupBy("face", "i", "j").agg(*(floor_div(F.sum(of(k)), F.count(of(k))).alias(k) for k in SIDES))
    return cells.join(around, ["face", "i", "j"], "left")


def amplitude(sigma: Column, f0_q16: int, ratio_q16: int, depth: int) -> Column:
    """Detail's amplitude ``depth`` levels below the native one (1 for its children): the
    roughness times f0, which falls by a ratio a level; both in sixteenths of bits."""
    decay = f0_q16
    for _ in range(depth - 1):
        decay = decay * ratio_q16 >> 16
    return F.shiftright(sigma * decay, 16)


def roughness(parents: DataFrame, level: int, native: DataFrame, native_level: int) -> DataFrame:
    """Adds sigma to cells (face, i, j) at ``level``: the roughness (column r) of the native
    cells around each, interpolated between their centres in integers, rounded down."""
    m, d = 1 << (level - native_level), level - native_level
    own = {c: F.shiftright(c, d) for c in "ij"}
    off = {c: 2 * F.col(c).bitwiseAND(F.lit(m - 1)) + 1 - m for c in "ij"}
    near = {c: F.when(off[c] < 0, -1).otherwise(1) for c in "ij"}
    whole = F.lit(2 * m)
    four = F.array(*(
        F.struct(
            (near["i"] if a else F.lit(0)).alias("di"), (near["j"] if b else F.lit(0)).alias("dj"),
            ((F.abs(off["i"]) if a else whole - F.abs(off["i"])) * (F.abs(off["j"]) if b else whole - F.abs(off["j"]))).alias("weight"),
        ) for a in (0, 1) for b in (0, 1)
    ))
    asked = parents.select("face", F.struct("i", "j").alias("_at"), own["i"].alias("i"), own["j"].alias("j"), F.inline(four))
    met = adjacency.around(asked, native_level).join(native.select(F.col("face").alias("tface"), F.col("i").alias("ti"), F.col("j").alias("tj"), "r"), ["tface", "ti", "tj"], "left")
    each = met.groupBy("face", "_at", "di", "dj").agg(F.max("weight").alias("weight"), floor_div(F.sum("r"), F.count("r")).alias("r"))
    here = F.max(F.when((F.col("di") == 0) & (F.col("dj") == 0), F.col("r")))
    known, lost = F.sum(F.col("weight") * F.col("r")), F.sum(F.when(F.col("r").isNull(), F.col("weight")))
    sums = each.groupBy("face", "_at").agg(floor_div(F.coalesce(known, F.lit(0)) + F.coalesce(lost, F.lit(0)) * F.coalesce(here, F.lit(0)), F.lit(4 * m * m)).alias("sigma"))
    return parents.join(sums.select("face", "_at.i", "_at.j", "sigma"), ["face", "i", "j"], "left")


def refined(cells: DataFrame, seed: int) -> DataFrame:
    """(face, i, j, p, q, child): four integer children of each cell (face, i, j, p, key,
    amplitude, and the neighbours of ``with_neighbours``); their sum is four times p.

    Missing neighbours count as p. The children follow the slope to the neighbours, in
    sixteenths, rounded by largest remainder, with a zero-sum detail from the key's hash."""
    near = {c: F.coalesce(F.col(c), F.col("p")) for c in SIDES}
    corners = [("w", "s", "sw"), ("w", "n", "nw"), ("e", "s", "se"), ("e", "n", "ne")]
    q4, add = range(4), lambda name: " + ".join(f"{name}{q}" for q in range(4))
    floor = lambda x, by: f"(({x}) - pmod({x}, {by}L)) div {by}L"
    df = cells.withColumns({f"_i{q}": 9 * F.col("p") + 3 * near[a] + 3 * near[b] + near[c] for q, (a, b, c) in enumerate(corners)})
    df = df.withColumn("_c", F.expr(f"64 * p - ({add('_i')})"))
    df = df.withColumns({f"_j{q}": F.expr(f"_i{q} + {floor('_c', 4)} + cast(pmod(_c, 4L) > {q} as long)") for q in q4})
    df = df.withColumns({f"_b{q}": F.expr(floor(f"_j{q}", 16)) for q in q4} | {f"_r{q}": F.expr(f"pmod(_j{q}, 16L)") for q in q4})
    ahead = {q: " + ".join(f"cast(_r{o} > _r{q} or {o < q} and _r{o} = _r{q} as int)" for o in q4 if o != q) for q in q4}
    df = df.withColumns({f"_b{q}": F.expr(f"_b{q} + cast({ahead[q]} < 4 * p - ({add('_b')}) as long)") for q in q4})
    df = with_detail_hashes(df, seed, "key", [f"_h{q}" for q in q4])
    df = df.withColumns({f"_h{q}": F.expr(f"shiftrightunsigned(_h{q}, 40) - {1 << 23}L") for q in q4})
    df = df.withColumns(dict(zip([f"_d{q}" for q in q4], zero_sum([f"_h{q}" for q in q4]), strict=True)))
    df = df.withColumns({f"_e{q}": F.expr(f"shiftright(_d{q} * amplitude, 23)") for q in q4})
    df = df.withColumns(dict(zip([f"_z{q}" for q in q4], zero_sum([f"_e{q}" for q in q4]), strict=True)))
    four = F.array(*(F.struct(F.lit(q).alias("q"), F.expr(f"_b{q} + _z{q}").alias("child")) for q in q4))
    return df.select("face", "i", "j", "p", F.inline(four))


def inherited(cells: DataFrame, native: DataFrame, depth: int, value: str) -> DataFrame:
    """Cells (face, i, j) ``depth`` levels below the native ones, with their ancestor's value."""
    up = native.select("face", F.col("i").alias("_i"), F.col("j").alias("_j"), value)
    own = cells.withColumns({"_i": F.shiftright("i", depth), "_j": F.shiftright("j", depth)})
    return own.join(up, ["face", "_i", "_j"], "left").drop("_i", "_j")


def guarded(children: DataFrame, threshold: int) -> DataFrame:
    """Adds boundary and output to refined children (..., p, low, high, child), low and high
    being the extremes around the parent: off a boundary no child leaves its parent's side."""
    boundary = (F.col("low") < threshold) & (F.col("high") >= threshold)
    side = F.when(F.col("p") >= threshold, F.greatest("child", F.lit(threshold))).otherwise(F.least("child", F.lit(threshold - 1)))
    return children.withColumns({"boundary": boundary, "output": F.when(boundary, F.col("child")).otherwise(side)})

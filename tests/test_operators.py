"""Cases that the driver's tables do not hold."""

import random

from pyspark.sql import functions as F

from orrery.functions import adjacency
from orrery.operators import content, graph, grid, ledger, sampling, states
from orrery.streaming import chains


def test_means_round_half_up_below_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, v) for v in (-3, -2, -2, -2)], "face int, i long, j long, raw long")
    assert grid.pyramid(df, "mean").first()["raw"] == -2
    assert df.select(grid.floor_div(F.lit(-9).cast("long"), F.lit(4).cast("long"))).first()[0] == -3


def test_nodata_is_left_out(spark):
    df = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 5), (1, 2, 2, None)], "face int, i long, j long, raw long")
    got = {(r.face, r.raw) for r in grid.pyramid(df, "mean").collect()}
    assert got == {(0, 5), (1, None)}


def test_mode_takes_the_lowest(spark):
    df = spark.createDataFrame([(0, 0, 0, v) for v in (9, 4, 4, 9)], "face int, i long, j long, raw long")
    assert grid.pyramid(df, "mode").first()["raw"] == 4


def test_children_sum_to_their_parents(spark):
    cells = spark.range(500).selectExpr("cast(0 as int) as face", "id as i", "0L as j", "id * 37 % 1001 - 500 as p", "id * 977 + 5 as key", "id % 90 * 64 as amplitude", *(f"case when id % {k + 2} > 0 then id * {k + 3} % 701 - 350 end as {c}" for k, c in enumerate(("w", "e", "s", "n", "sw", "se", "nw", "ne"))))
    kids = states.refined(cells, 99).groupBy("i", "p").agg(F.sum("child").alias("total"), F.count(F.lit(1)).alias("n"))
    assert kids.where("total <> 4 * p or n <> 4").count() == 0


def test_neighbours_across_edges_and_corners(spark):
    level, n = 2, 4
    cells = spark.range(6 * 16).selectExpr("cast(id div 16 as int) as face", "id div 4 % 4 as i", "id % 4 as j", "id as p")
    got = {(r.face, r.i, r.j): r.asDict() for r in states.with_neighbours(cells, level).collect()}
    beyond = {(r[0], r[1]): r[2:] for r in adjacency.rows()}

    def value(face, i, j):
        return face * 16 + i * 4 + j

    def across(face, i, j, edge):
        to, to_edge, flip = beyond[face, edge]
        along = n - 1 - (j if edge < 2 else i) if flip else (j if edge < 2 else i)
        end = 0 if to_edge % 2 == 0 else n - 1
        return value(to, end, along) if to_edge < 2 else value(to, along, end)

    assert len(got) == 96
    for (face, i, j), row in got.items():
        for side, (di, dj) in states.SIDES.items():
            a, b = i + di, j + dj
            ci, cj = min(max(a, 0), 3), min(max(b, 0), 3)
            eu = 0 if a < 0 else 1 if a > 3 else None
            ev = 2 if b < 0 else 3 if b > 3 else None
            edges = [e for e in (eu, ev) if e is not None]
            want = [across(face, ci, cj, e) for e in edges] or [value(face, a, b)]
            assert row[side] == sum(want) // len(want), (face, i, j, side)


def test_roughness_between_native_cells(spark):
    native = spark.range(6 * 16).selectExpr("cast(id div 16 as int) as face", "id div 4 % 4 as i", "id % 4 as j", "id * 7 % 50 as r")
    by = {(r.face, r.i, r.j): r.r for r in native.collect()}
    parents = spark.range(16 * 16).selectExpr("2 as face", "id div 16 as i", "id % 16 as j")
    for r in states.roughness(parents, 4, native, 2).where("i between 4 and 11 and j between 4 and 11").collect():
        m, x, y = 4, 2 * (r.i % 4) + 1 - 4, 2 * (r.j % 4) + 1 - 4
        total = 0
        for a in (0, 1):
            for b in (0, 1):
                w = (abs(x) if a else 2 * m - abs(x)) * (abs(y) if b else 2 * m - abs(y))
                total += w * by[2, r.i // 4 + a * (-1 if x < 0 else 1), r.j // 4 + b * (-1 if y < 0 else 1)]
        assert r.sigma == total // (4 * m * m)
    same = states.roughness(parents.where("i < 4 and j < 4"), 2, native, 2).collect()
    assert all(r.sigma == by[2, r.i, r.j] for r in same)


def test_exact_integers(spark):
    big = 3 * 9007199254740993
    row = spark.range(1).select(grid.floor_div(F.lit(big), F.lit(3)).alias("a"), grid.floor_div(F.lit(-7), F.lit(2)).alias("b"), grid.floor_div(F.lit(7), F.lit(-2)).alias("c"), grid.floor_div(F.lit(-8), F.lit(2)).alias("d")).first()
    assert tuple(row) == (9007199254740993, -4, -4, -4)
    most = spark.createDataFrame([(4294967295,), (4294967295,), (4294967294,)], "raw long")
    assert most.agg(grid.reduced("rms").alias("rms")).first().rms == 4294967295


def test_paths_by_the_rules(spark):
    bad = ["COM¹", "a/lpt³.txt", "CONIN$", "conout$", "nul.txt", "a b/aux", "x:y", "a//b", "..", "a/", "a.", "a ", "a\\b", "q?", "x\x1fy"]
    good = ["CONOUT$.txt", "console", "COM0", "COM10", "com", "a/b.c", "x\x7fy", "é"]
    rows = spark.createDataFrame([(p,) for p in bad + good], "path string").select("path", content.path_error(F.col("path")).alias("e")).collect()
    assert {r.path for r in rows if r.e is None} == set(good)
    keys = spark.createDataFrame([("Same",), ("same",), ("caf\u00e9",), ("cafe\u0301",), ("other",)], "path string")
    assert {(r.key, r.paths) for r in content.aliases(keys).collect()} == {("SAME", 2), ("CAF\u00c9", 2)}


def test_closures_and_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("a", None)], "id string, needs string")
    got = graph.closure(edges)
    assert {(r.id, r.needs, r.depth) for r in got.collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1), ("x", "y", 1), ("y", "x", 1), ("x", "x", 2), ("y", "y", 2)}
    assert {tuple(r) for r in graph.cycles(got).collect()} == {("x", 2), ("y", 2)}
    assert graph.closure(edges.limit(0)).count() == 0
    rows = [(k, k - 1 if k else None, 1.5) for k in range(40)] + [(50, 51, 1.0), (51, 50, 1.0), (52, 50, 1.0), (60, 99, 1.0), (61, 60, 1.0)]
    got = {r.id: r for r in graph.chains(spark.createDataFrame(rows, "id long, base long, v double"), "v").collect()}
    assert all((got[k].end, got[k].total, got[k].steps, got[k].code) == (0, 1.5 * k, k, None) for k in range(40))
    assert {k: r.code for k, r in got.items() if k >= 40} == {50: "cycle", 51: "cycle", 52: "cycle", 60: "dangling", 61: "dangling"}


def test_chains_end_when_only_cycles_are_open(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "kept", lambda df, name, kept=graph.kept: written.append(name) or kept(df, name))
    rows = spark.range(2000).selectExpr("id", "case when id < 4 then nullif(id - 1, -1) else id - id % 4 + (id + 1) % 4 end as base", "1.0 as v")
    got = {r.id: (r.end, r.total, r.steps, r.code) for r in graph.chains(rows, "v").collect()}
    assert got == {k: (0, float(k), k, None) if k < 4 else (None, None, None, "cycle") for k in range(2000)}
    assert len(written) == 4  # the first pointers; two rounds for the chain of three; one that closes nothing


def test_bodies_are_not_broadcast_to_their_contracts(spark, tmp_path):
    from orrery.operators import model
    from orrery.plans import bodies

    spark.range(1, 300).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    model.parsed(bodies._bodies(spark, str(tmp_path))).write.parquet(str(tmp_path / "roots"))
    roots, contracts = spark.read.parquet(str(tmp_path / "roots")), bodies._contracts(spark)
    for judged in (model.capabilities(roots, contracts), model.features(roots, contracts)):
        plan = judged._jdf.queryExecution().executedPlan().toString()
        met = [x for x in plan.splitlines() if "Join [id#" in x]
        assert met and all("BroadcastHashJoin" in x and "BuildRight" in x for x in met), plan


def test_as_of_by_slots(spark):
    rng = random.Random(3)
    known = spark.createDataFrame([(rng.randint(0, 3), rng.randint(0, 300), k) for k in range(80)] + [(None, 5, 1)], "k long, t long, v long")
    asked = spark.createDataFrame([(rng.randint(0, 4), rng.randint(-5, 320), k) for k in range(120)] + [(None, 9, 500)], "k long, t long, id long")
    plain = {r.id: (r.v, r.state_at) for r in states.as_of(asked, known, "k", "t", ["v"]).collect()}
    cut = {r.id: (r.v, r.state_at) for r in states.as_of(asked, known, "k", "t", ["v"], F.expr("t div 20")).collect()}
    assert plain == cut and len(plain) == 121 and plain[500] == (1, 5)


def test_points_without_a_value_stay(spark):
    field = spark.createDataFrame([(0, 0, 0, 5.0)], "face int, i long, j long, value double")
    points = spark.createDataFrame([(1, 1.0, -0.9, -0.9), (2, -1.0, 0.1, 0.0), (3, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: (r.value, r.weight) for r in sampling.bilinear(points, field, 2).collect()}
    assert got[1][0] == 5.0 and got[1][1] > 0 and got[2] == (None, 0.0) and got[3] == (None, 0.0)


def test_as_of_takes_the_last_state_at_or_before(spark):
    known = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c"), (None, 1, "d")], "k long, t long, v string")
    asked = spark.createDataFrame([(1, 9, 0), (1, 10, 1), (1, 25, 2), (2, 1, 3), (3, 9, 4)], "k long, t long, id long")
    got = {r.id: r.v for r in states.as_of(asked, known, "k", "t", ["v"]).collect()}
    assert got == {0: None, 1: "a", 2: "b", 3: None, 4: None}


def test_folders_that_are_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("a", "a/b", "ab", "a/b/c", "x/y")], "path string")
    got = {tuple(r) for r in content.prefix_collisions(paths).collect()}
    assert got == {("A", "A/B"), ("A", "A/B/C"), ("A/B", "A/B/C")}


def _chain(n: int) -> list[tuple]:
    import hashlib

    rows, prev = [], ledger.GENESIS
    for k in range(n):
        text = "|".join((f"p{k}", prev, str(k), str(k * 10), "set"))
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append((1, k, prev, "set", f"p{k}", k * 10, digest))
        prev = digest
    return rows


SCHEMA = "ledger long, seq long, prev string, type string, payload string, t long, hash string"


def test_ledger_errors(spark):
    rows = _chain(8)
    assert ledger.violations(spark.createDataFrame(rows, SCHEMA), "ledger").count() == 0
    bad = [list(r) for r in rows]
    bad[2][4] = "other"
    bad[4][2] = "0" * 64
    bad[6][3] = ""
    got = {(r.seq, r.error) for r in ledger.violations(spark.createDataFrame(bad, SCHEMA), "ledger").collect()}
    assert got == {(2, "TamperedEntry"), (4, "BrokenChain"), (6, "InvalidEntry")}


def test_ledger_as_a_stream(spark, tmp_path):
    rows = _chain(9)
    rows[5] = (*rows[5][:4], "other", *rows[5][5:])
    folder = tmp_path / "in"
    for k in range(3):  # three batches, so that the head is carried in state
        spark.createDataFrame(rows[3 * k : 3 * k + 3], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = "verdicts"
    chains.verified(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: r.error for r in spark.table(name).collect()}
    assert len(got) == 9 and got[5] in ("TamperedEntry", "BrokenChain", "InvalidEntry")


def test_valid_metadata_breaks_no_rule(spark):
    from orrery.operators import validate

    form = "id string, capability string, domain string, semantic string, persistence string, dtype string, scale string, nodata long, interp string, downsample string, native_level int, slices int, compat string"
    good = ("1", "topography", "faces", "scalar.height", "invariant", "i16", "0.5", -32768, "bilinear", "mean", 7, None, "critical")
    fields = spark.createDataFrame([good], form).withColumn("slices", F.lit(12))
    domains = spark.createDataFrame([("faces", "cube", 10)], "id string, topology string, max_level int")
    known = spark.createDataFrame([("topography",), ("solid_surface",)], "id string")
    assert validate.fields(fields, domains, known).count() == 0
    requires = spark.createDataFrame([("topography", "solid_surface"), ("ocean", "topography")], "id string, needs string")
    assert validate.capabilities(known, requires).count() == 0
    assert [r.code for r in validate.capabilities(known.where("id = 'topography'"), requires).collect()] == ["capability-missing"]
    # a null where a value is needed is a breach
    assert {r.code for r in validate.fields(fields.withColumn("scale", F.lit(None).cast("string")), domains, known).collect()} == {"field-scale"}
    index = spark.createDataFrame([("a", 1, "d1", None, "u8"), ("a", 2, None, 300, "u8"), ("a", 3, "d9", None, "u8"), ("a", 4, None, None, "u8")], "field_id string, key long, digest string, const_raw long, dtype string")
    got = {tuple(r) for r in validate.content(index, spark.createDataFrame([("d1",)], "digest string")).collect()}
    assert got == {("const-range", "2"), ("blob-missing", "3"), ("const-or-blob", "4")}

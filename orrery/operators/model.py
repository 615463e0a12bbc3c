"""Validation of body roots: what a root document has to say about itself, as violation rows.

Bodies are JSON documents, one a row. ``parsed`` turns them into nested columns; each function
then judges one part of all of them in a projection, an explode or an equi-join and yields rows
(body, code, subject). A valid body has none. ``violations`` is all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.bits import fenced
from orrery.functions.documents import conforms
from orrery.operators.graph import chains
from orrery.operators.validate import POSITIVE
from orrery.session import kept, sorted_join

#: What a version-1 root declares.
SCHEMA, MAJOR, CODEC = "body/1", 1, "zstd+shuffle2"
CORE = ("body/1", "canon.jcs/1", "topo.dir_cube/1", "topo.radial_1d/1", "codec.zstd-shuffle2/1")
MANDATORY = ("body/1", "canon.jcs/1", "codec.zstd-shuffle2/1")
CUBE, RADIAL = "topo.dir_cube/1", "topo.radial_1d/1"
FRAME, INERTIAL = "body_fixed", "universe_inertial"
AXES = "+Z is the positive rotation pole; +X is the prime meridian; right-handed"
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?(e(-?[1-9][0-9]*|0))?$"
ZERO = r"^-(0|0\.0+|0?\.0+)(e.*)?$"
HASH, FIELD = "^b3:[0-9a-f]{64}$", "^0x(?!0000)[0-9a-f]{4}(?!0000)[0-9a-f]{4}$"
#: The members that are read; others stay in the document.
ROOT = """struct<schema: string, format_version: struct<major: int, minor: int>, required_features: array<string>, codec: string,
physical: struct<gm_m3_s2: string>, figure: struct<kind: string, radius_m: string, radius_field: string, extent_m: string>,
frames: map<string, struct<axes: string, rotation: struct<kind: string, relative_to: string, period_s: string, epoch: string, orientation_q_at_epoch: array<string>>>>,
reference_surfaces: array<struct<id: string, kind: string, base: string, radius_m: string, offset_m: string>>,
domains: array<struct<id: string, topology: string, frame: string, tile_log2: int, max_level: int, vertical: struct<kind: string, extent_m: string>>>,
capabilities: array<struct<id: string, params: string, compat: string>>,
sections: struct<vocab: array<struct<name: string, path: string, hash: string>>, features: array<struct<name: string, path: string, hash: string>>>,
indexes: map<string, string>>"""


def parsed(bodies: DataFrame) -> DataFrame:
    """(body, root) of documents (body, doc); null for what is no JSON or repeats a name.

    Documents and roots are fenced: each is made once a row, not at every reference."""
    docs = fenced(bodies.select("body", "doc"), "doc")
    return fenced(docs.select("body", F.when(F.try_parse_json("doc").isNotNull(), F.from_json("doc", ROOT)).alias("root")), "root")


def positive(text: Column) -> Column:
    """Whether a decimal text is above zero; false for null."""
    return F.coalesce(F.rlike(text, F.lit(POSITIVE)), F.lit(False))


def decimal(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(DECIMAL)) & ~F.rlike(text, F.lit(ZERO)), F.lit(False))


def _broken(df: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that does not hold; a rule that is null does not hold."""
    each = F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(code)) for code, good in rules.items()))
    return df.select("body", F.explode(F.array_compact(each)).alias("code"), subject.alias("subject"))


def _items(roots: DataFrame, member: str) -> DataFrame:
    return roots.select("body", F.explode(f"root.{member}").alias("item"))


def _twice(items: DataFrame, code: str) -> DataFrame:
    count = items.groupBy("body", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return count.select("body", F.lit(code).alias("code"), F.col("id").alias("subject"))


def roots(df: DataFrame) -> DataFrame:
    """Schema, version, gravity, codec, frame and figure."""
    r = lambda path: F.col(f"root.{path}")
    frame = F.try_element_at(r("frames"), F.lit(FRAME))
    turn = frame["rotation"]
    q = turn["orientation_q_at_epoch"]
    norm = F.aggregate(q, F.lit(0.0), lambda s, x: s + x.try_cast("double") * x.try_cast("double"))
    exact = F.rlike(turn["epoch"], F.lit("^(0|-?[1-9][0-9]{0,38})$"))
    kind = r("figure.kind")
    shape = F.when(kind == "sphere", positive(r("figure.radius_m"))).when(kind == "star_convex_radial", r("figure.radius_field") != "").when(kind == "radial_profile_sphere", positive(r("figure.extent_m")))
    named = F.forall(F.concat(F.coalesce(r("sections.vocab"), F.array()), F.coalesce(r("sections.features"), F.array())), lambda x: F.coalesce(x["name"] != "", F.lit(False)))
    return _broken(df, F.lit(""), {
        "UnsupportedSchema": r("schema") == SCHEMA,
        "UnsupportedMajorVersion": r("format_version.major") == MAJOR,
        "InvalidDecimal": positive(r("physical.gm_m3_s2")),
        "InvalidFrame": (frame["axes"] == AXES) & (turn["kind"] == "uniform") & (turn["relative_to"] == INERTIAL) & positive(turn["period_s"]) & exact
        & (F.size(q) == 4) & F.forall(q, decimal) & (F.abs(norm - 1) <= 1e-12),
        "InvalidFigure": shape,
        "InvalidSection": named,
        "UnknownRequiredFeature": r("codec") == CODEC,
    })


def features(df: DataFrame, known: DataFrame) -> DataFrame:
    """Required features that are repeated or that neither the core nor ``known`` (id) has, and
    mandatory ones that are not declared. ``known`` is a registry and is broadcast."""
    declared = df.select("body", F.explode("root.required_features").alias("id"))
    every = known.select("id").unionByName(df.sparkSession.createDataFrame([(c,) for c in CORE], "id string")).distinct()
    unknown = declared.distinct().join(F.broadcast(every), "id", "left_anti").select("body", F.lit("UnknownRequiredFeature").alias("code"), F.col("id").alias("subject"))
    lacks = F.array_except(F.array(*map(F.lit, MANDATORY)), F.coalesce("root.required_features", F.array().cast("array<string>")))
    missing = df.select("body", F.lit("MissingRequiredFeature").alias("code"), F.explode(lacks).alias("subject"))
    return unknown.unionByName(missing).unionByName(_twice(declared, "InvalidFeatureList"))


def domains(df: DataFrame) -> DataFrame:
    d = df.select("body", "root", F.explode("root.domains").alias("item"))
    i = lambda c: F.col(f"item.{c}")
    vertical = F.when(i("topology") == CUBE, i("vertical.kind") == "none").when(i("topology") == RADIAL, (i("vertical.kind") == "radius") & positive(i("vertical.extent_m")))
    good = (
        (i("id") != "") & (i("frame") == FRAME) & i("tile_log2").between(0, 30) & i("max_level").between(0, 30) & vertical
        & F.map_contains_key("root.frames", i("frame")) & F.array_contains("root.required_features", i("topology"))
    )
    return _broken(d, i("id"), {"InvalidDomain": good}).unionByName(_twice(d.select("body", i("id").alias("id")), "InvalidDomain"))


def surfaces(df: DataFrame) -> DataFrame:
    """Kinds and parameters; ids that repeat; bases that are no surface or form a cycle."""
    s = df.select("body", F.col("root.figure.kind").alias("figure"), F.explode("root.reference_surfaces").alias("item"))
    i = lambda c: F.col(f"item.{c}")
    of_kind = F.when(i("kind") == "sphere", positive(i("radius_m"))).when(i("kind") == "offset_of", decimal(i("offset_m"))).when(i("kind") == "figure_surface", F.coalesce(F.col("figure") != "radial_profile_sphere", F.lit(True)))
    bad = _broken(s, i("id"), {"InvalidSurface": (i("id") != "") & of_kind})
    base = F.when(i("kind") == "offset_of", F.coalesce(i("base"), F.lit("")))
    key = lambda x: F.when(x.isNotNull(), F.struct("body", x.alias("id")))
    rows = s.where(i("id").isNotNull()).select(key(i("id")).alias("id"), key(base).alias("base"), F.lit(0.0).alias("offset")).dropDuplicates(["id"])
    found = chains(rows, "offset").where("code is not null")
    code = F.when(F.col("code") == "cycle", "SurfaceCycle").otherwise("InvalidSurface")
    return bad.unionByName(found.select("id.body", code.alias("code"), F.col("id.id").alias("subject"))).unionByName(_twice(s.select("body", i("id").alias("id")), "InvalidSurface"))


def indexes(df: DataFrame) -> DataFrame:
    x = df.select("body", F.explode("root.indexes").alias("field", "hash"))
    return _broken(x, F.col("field"), {"InvalidFieldId": F.rlike("field", F.lit(FIELD)), "BadTextForm": F.rlike("hash", F.lit(HASH))})


def capabilities(df: DataFrame, contracts: DataFrame) -> DataFrame:
    """Against contracts (id, requires array<string>, refs map<string, string>, kinds
    array<string>): unknown critical ones, missing requirements, parameters that refer to no
    domain, surface or figure, and surface kinds that nothing declares.

    Contracts are a registry, which does not grow with the bodies, and are broadcast: their size
    is unknown to the optimizer, which would broadcast the bodies to them instead."""
    contracts = F.broadcast(contracts)
    c = df.select("body", "root", F.explode("root.capabilities").alias("item"))
    c = c.select("body", "root", F.col("item.id").alias("id"), F.from_json("item.params", "map<string, string>").alias("params"), F.coalesce("item.compat", F.lit("critical")).alias("compat"))
    row = lambda d, code, subject: d.select("body", F.lit(code).alias("code"), subject.alias("subject"))
    bad = row(c.where("id is null or id = '' or params is null"), "InvalidCapability", F.coalesce("id", F.lit(""))).unionByName(_twice(c, "InvalidCapability"))
    unknown = row(c.join(contracts, "id", "left_anti").where("compat = 'critical'"), "UnknownCriticalCapability", F.col("id"))
    met = c.join(contracts, "id")
    need = met.select("body", F.explode("requires").alias("id"))
    lost = row(need.join(sorted_join(c.select("body", "id").distinct()), ["body", "id"], "left_anti").distinct(), "MissingCapabilityDependency", F.col("id"))
    round_body = F.col("root.figure.kind") != "radial_profile_sphere"
    ask = met.select("body", "root", "params", F.explode("refs").alias("param", "target")).withColumn("value", F.try_element_at("params", F.col("param"))).where("value is not null")
    holds = lambda member: F.exists(F.coalesce(F.col(f"root.{member}.id"), F.array().cast("array<string>")), lambda x: x == F.col("value"))
    there = F.when(F.col("target") == "domain", holds("domains")).when(F.col("target") == "reference_surface", holds("reference_surfaces")).when(F.col("target") == "figure", (F.col("value") == "figure") & round_body)
    refs = row(ask.where(~F.coalesce(there, F.lit(False))), "InvalidCapabilityReference", F.col("param"))
    of_figure = F.exists(F.map_entries("refs"), lambda e: (e["value"] == "figure") & F.coalesce(F.try_element_at(F.col("params"), e["key"]) == "figure", F.lit(False)))
    kinds = met.select("body", "root", "params", "refs", F.explode("kinds").alias("kind"))
    shown = F.coalesce(F.array_contains("root.reference_surfaces.kind", F.col("kind")), F.lit(False)) | ((F.col("kind") == "figure_surface") & round_body & of_figure)
    surface = row(kinds.where(~F.coalesce(shown, F.lit(False))), "InvalidCapabilityReference", F.col("kind"))
    return reduce(DataFrame.unionByName, (bad, unknown, lost, refs, surface))


def parameters(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Capability parameters that break their contract's JSON schema, one a capability."""
    c = _items(df, "capabilities").select("body", F.col("item.id").alias("id"), F.col("item.params").alias("params"))
    parts = [c.where(F.col("id") == name).withColumn("at", conforms(schema)("params")) for name, schema in schemas.items()]
    found = reduce(DataFrame.unionByName, parts).where("at is not null")
    return found.select("body", F.lit("InvalidCapabilityParameters").alias("code"), F.concat_ws(" ", "id", "at").alias("subject"))


def violations(bodies: DataFrame, contracts: DataFrame) -> DataFrame:
    """Every (body, code, subject) of documents (body, doc); "InvalidJson" where one does not parse."""
    df = kept(parsed(bodies), "roots")  # read once, judged part by part
    unread = df.where("root is null").select("body", F.lit("InvalidJson").alias("code"), F.lit("").alias("subject"))
    df = df.where("root is not null")
    parts = (unread, roots(df), features(df, contracts), domains(df), surfaces(df), indexes(df), capabilities(df, contracts))
    return reduce(DataFrame.unionByName, parts)


def summary(bodies: DataFrame) -> DataFrame:
    """(body, fields, capabilities, domains, surfaces): what each body declares."""
    size = lambda c: F.coalesce(F.size(f"root.{c}"), F.lit(0))
    return parsed(bodies).select("body", size("indexes").alias("fields"), size("capabilities").alias("capabilities"), size("domains").alias("domains"), size("reference_surfaces").alias("surfaces"))

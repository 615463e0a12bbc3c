"""Queries over body roots: documents made of the customers, spoiled by their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import content, model
from orrery.session import spread, table

QUERIES: dict = {}
SQL: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


#: A member's text where the key k is a multiple of a number, and else; both engines read it.
_SPOILED = {
    "schema": (11, "body/2", "body/1"), "major": (13, "2", "1"), "gm": (17, "0.0", "3.986e14"), "codec": (19, "gzip", "zstd+shuffle2"), "axes": (23, "other", model.AXES),
    "period": (29, "-1", "86164.0905"), "w": (31, "0.5", "1"), "radius": (37, "-6e6", "6371000"), "extra": (41, "unknown/1", "topo.dir_cube/1"), "mandatory": (43, "topo.radial_1d/1", "canon.jcs/1"),
    "level": (47, "31", "9"), "vertical": (53, "radius", "none"), "base": (59, "cloud", "datum"), "lost": (61, "nowhere", "datum"), "offset": (67, "x", "-3.25"),
    "index": (71, "0x00010000", "0x00010002"), "digest": (73, "b3:00", "b3:" + "ab" * 32), "cap": (79, "weather", "topography"), "domain": (83, "shells", "faces"), "solid": (89, "topography", "solid_surface"),
}
_TEXT = (
    '{"schema": "#schema", "format_version": {"major": #major, "minor": 3}, "required_features": ["body/1", "#mandatory", "codec.zstd-shuffle2/1", "topo.dir_cube/1", "#extra"], "codec": "#codec", '
    '"physical": {"gm_m3_s2": "#gm"}, "figure": {"kind": "sphere", "radius_m": "#radius"}, '
    '"frames": {"body_fixed": {"axes": "#axes", "rotation": {"kind": "uniform", "relative_to": "universe_inertial", "period_s": "#period", "epoch": "0", "orientation_q_at_epoch": ["#w", "0", "0", "0"]}}}, '
    '"reference_surfaces": [{"id": "datum", "kind": "sphere", "radius_m": "6371000"}, {"id": "sea", "kind": "offset_of", "base": "#base", "offset_m": "#offset"}, {"id": "cloud", "kind": "offset_of", "base": "sea", "offset_m": "900"}, '
    '{"id": "haze", "kind": "offset_of", "base": "#lost", "offset_m": "1e4"}], '
    '"domains": [{"id": "faces", "topology": "topo.dir_cube/1", "frame": "body_fixed", "tile_log2": 3, "max_level": #level, "vertical": {"kind": "#vertical"}}], '
    '"capabilities": [{"id": "#solid", "params": {"figure": "figure"}}, {"id": "#cap", "params": {"domain": "#domain"}}], '
    '"indexes": {"#index": "#digest"}, "x-note": [1, {"deep": true}]}'
)
_CONTRACTS = [("solid_surface", [], {"figure": "figure"}, ["figure_surface"]), ("topography", ["solid_surface"], {"domain": "domain"}, ["sphere"])]


def _bodies(spark, sf_dir):
    doc = F.lit(_TEXT)
    for name, (by, bad, good) in _SPOILED.items():
        doc = F.replace(doc, F.lit(f"#{name}"), F.when(F.col("c_custkey") % by == 0, bad).otherwise(good))
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), 20_000).select(F.col("c_custkey").alias("body"), F.when(F.col("c_custkey") % 97 == 0, "{").otherwise(doc).alias("doc"))


def _contracts(spark):
    return spark.createDataFrame(_CONTRACTS, "id string, requires array<string>, refs map<string, string>, kinds array<string>")


def _when(name: str, code: str, subject: str = "") -> str:
    return f"SELECT k AS body, '{code}' AS code, '{subject}' AS subject FROM b WHERE k % {_SPOILED[name][0]} = 0"


_EXPECTED = [
    _when("schema", "UnsupportedSchema"), _when("major", "UnsupportedMajorVersion"), _when("gm", "InvalidDecimal"), _when("codec", "UnknownRequiredFeature"), _when("radius", "InvalidFigure"),
    "SELECT k, 'InvalidFrame', '' FROM b WHERE k % 23 = 0 OR k % 29 = 0 OR k % 31 = 0", _when("extra", "UnknownRequiredFeature", "unknown/1"), _when("mandatory", "MissingRequiredFeature", "canon.jcs/1"),
    "SELECT k, 'InvalidFeatureList', 'topo.dir_cube/1' FROM b WHERE k % 41 <> 0", "SELECT k, 'InvalidDomain', 'faces' FROM b WHERE k % 47 = 0 OR k % 53 = 0",
    _when("base", "SurfaceCycle", "sea"), _when("base", "SurfaceCycle", "cloud"), _when("lost", "InvalidSurface", "haze"), _when("offset", "InvalidSurface", "sea"),
    _when("index", "InvalidFieldId", "0x00010000"), "SELECT k, 'BadTextForm', CASE WHEN k % 71 = 0 THEN '0x00010000' ELSE '0x00010002' END FROM b WHERE k % 73 = 0",
    _when("cap", "UnknownCriticalCapability", "weather"), "SELECT k, 'InvalidCapabilityReference', 'domain' FROM b WHERE k % 83 = 0 AND k % 79 <> 0",
    "SELECT k, 'InvalidCapability', 'topography' FROM b WHERE k % 89 = 0 AND k % 79 <> 0",
    "SELECT k, 'MissingCapabilityDependency', 'solid_surface' FROM b WHERE k % 89 = 0",
]


@query(f"WITH b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 97 <> 0) SELECT c_custkey AS body, 'InvalidJson' AS code, '' AS subject FROM customer WHERE c_custkey % 97 = 0 UNION ALL {' UNION ALL '.join(_EXPECTED)}")
def body_violations(spark, sf_dir):
    """Every rule that a root breaks, over a document a customer."""
    return model.violations(_bodies(spark, sf_dir), _contracts(spark))


@query("SELECT c_custkey AS body, CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 1 END AS fields, CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 2 END AS capabilities, CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 1 END AS domains, CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 4 END AS surfaces FROM customer")
def body_summary(spark, sf_dir):
    return model.summary(_bodies(spark, sf_dir))


#: The parameters' schema of one capability.
_PARAMS = '{"type": "object", "required": ["domain"], "additionalProperties": false, "properties": {"domain": {"enum": ["faces"], "x-reference": "domain"}}}'


@query("SELECT c_custkey AS body, 'InvalidCapabilityParameters' AS code, CASE WHEN c_custkey % 89 = 0 THEN 'topography $.domain: required' ELSE 'topography $.domain: enum' END AS subject FROM customer WHERE c_custkey % 97 <> 0 AND ((c_custkey % 83 = 0 AND c_custkey % 79 <> 0) OR c_custkey % 89 = 0)"
       " UNION ALL SELECT c_custkey, 'InvalidCapabilityParameters', 'topography $.domain: enum' FROM customer WHERE c_custkey % 97 <> 0 AND c_custkey % 83 = 0 AND c_custkey % 79 <> 0 AND c_custkey % 89 = 0")
def capability_parameters(spark, sf_dir):
    """Capability parameters against a JSON schema."""
    return model.parameters(model.parsed(_bodies(spark, sf_dir)), {"topography": _PARAMS})


_REFS = "SELECT doc_id % 400 AS body, source || '/' || (doc_id % 40) || '.json' AS path, sha256(text) AS hash FROM documents"


@query(f"WITH r AS ({_REFS}), a AS (SELECT DISTINCT path, hash FROM r WHERE body % 3 <> 0), b AS (SELECT DISTINCT path, hash FROM r WHERE body % 5 <> 0) SELECT *, 'missing' AS gap FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'extra' FROM (FROM b EXCEPT FROM a)")
def closure_gaps(spark, sf_dir):
    """References without a section and sections without a reference, by path and hash."""
    r = _refs(spark, sf_dir)
    return content.closure_gaps(r.where("body % 3 <> 0"), r.where("body % 5 <> 0"))


def _refs(spark, sf_dir):
    path = F.concat("source", F.lit("/"), (F.col("doc_id") % 40).cast("string"), F.lit(".json"))
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("body"), path.alias("path"), F.sha2("text", 256).alias("hash"))


@query(f"WITH r AS ({_REFS}), s AS (SELECT DISTINCT body, path, hash FROM r) SELECT body, count(*)::BIGINT AS sections, sha256(string_agg(path || '=' || hash, ';' ORDER BY path || '=' || hash)) AS root FROM s GROUP BY body")
def merkle_roots(spark, sf_dir):
    """A body's identity over the sorted list of its sections."""
    return content.merkle(_refs(spark, sf_dir))


_INDEX = """SELECT sha256((l_partkey % 200)::VARCHAR) AS digest, (l_orderkey % 12)::INT AS level, CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'cube' ELSE 'radial' END AS topology,
CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber * 12 END AS slices, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 2 END AS width FROM lineitem"""


@query(f"""WITH i AS ({_INDEX}) SELECT digest, max(least(67108864, CASE topology WHEN 'cube' THEN power(4, least(level, 7)) WHEN 'radial' THEN power(2, least(level, 7)) END * coalesce(slices, 65535) * coalesce(width, 4) + 16)::BIGINT) FILTER (topology IS NOT NULL) AS l0,
bool_or(topology IS NULL) AS unknown FROM i GROUP BY digest""".replace("SELECT digest, max", "SELECT digest, CASE WHEN unknown THEN 67108864 ELSE l0 END AS \"limit\" FROM (SELECT digest, max") + ")")
def blob_limits(spark, sf_dir):
    """The bytes that each blob may have, by the entries that refer to it."""
    i = table(spark, sf_dir, "lineitem").select(
        F.sha2((F.col("l_partkey") % 200).cast("string"), 256).alias("digest"), (F.col("l_orderkey") % 12).cast("int").alias("level"), F.lit(7).alias("tile_log2"),
        F.when(F.col("l_suppkey") % 7 == 0, None).when(F.col("l_suppkey") % 2 == 0, "cube").otherwise("radial").alias("topology"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") * 12).alias("slices"), F.when(F.col("l_partkey") % 9 != 0, 2).alias("width"),
    )
    return content.limits(i)

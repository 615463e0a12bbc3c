"""Validation of metadata tables: every rule is a predicate or a join that yields rows
(code, subject), so that an artifact of any size is judged in a few passes and a valid
one gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.grid import dtype_fits
from orrery.session import sorted_join

#: The closed sets of field metadata.
PERSISTENCE = ("invariant", "periodic_mean", "initial_state")
DOWNSAMPLE = ("mean", "min", "max", "sum", "rms", "mode_lowest_tiebreak")
DTYPES = ("u8", "i8", "u16", "i16", "u32", "i32", "f32")
INTERP = {"cube": ("bilinear", "nearest"), "radial": ("linear",)}
SEMANTIC = r"^(scalar\.[a-z_]+|category|feature_ref|flags)$"
POSITIVE = r"^(?=.*[1-9])(0|[1-9][0-9]*)(\.[0-9]+)?(e(-?[1-9][0-9]*|0))?$"


def broken(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks, in one pass over ``df``."""
    each = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items()))
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(F.array_compact(each)).alias("code")).select("code", "subject")


def repeated(df: DataFrame, subject: str, code: str) -> DataFrame:
    twice = df.groupBy(F.col(subject).cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.select(F.lit(code).alias("code"), "subject")


def dangling(df: DataFrame, subject: str, ref: str, known: DataFrame, code: str) -> DataFrame:
    """Subjects whose reference is not among the ids of ``known``; null refers to nothing."""
    refs = df.where(F.col(ref).isNotNull()).select(F.col(subject).cast("string").alias("subject"), F.col(ref).alias("id"))
    return refs.join(sorted_join(known.select("id").distinct()), "id", "left_anti").select(F.lit(code).alias("code"), "subject")


def fields(fields_: DataFrame, domains: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Violations of a field registry; fields marked ancillary are judged by their ids alone."""
    critical = fields_.where("compat = 'critical'")
    met = critical.join(domains.select(F.col("id").alias("domain"), "topology", "max_level"), "domain", "left")
    interp = F.when(F.col("topology") == "radial", F.col("interp").isin(*INTERP["radial"])).otherwise(F.col("interp").isin(*INTERP["cube"]))
    rules = {
        "field-semantic": ~F.rlike("semantic", F.lit(SEMANTIC)),
        "field-persistence": ~F.col("persistence").isin(*PERSISTENCE),
        "field-dtype": ~F.col("dtype").isin(*DTYPES),
        "field-scale": ~F.rlike("scale", F.lit(POSITIVE)),
        "field-nodata": F.col("nodata").isNotNull() & ~dtype_fits(F.col("nodata"), F.col("dtype")),
        "field-interp": ~interp,
        "field-downsample": ~F.col("downsample").isin(*DOWNSAMPLE),
        "field-level": F.col("max_level").isNotNull() & ~F.col("native_level").between(0, F.col("max_level")),
        "field-temporal": (F.col("slices") < 1) | (F.col("slices") > 65535),
    }
    return (
        broken(met, "id", rules)
        .unionByName(repeated(fields_, "id", "field-duplicate"))
        .unionByName(dangling(critical, "id", "domain", domains, "field-domain"))
        .unionByName(dangling(critical, "id", "capability", capabilities, "field-capability"))
    )


def content(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Violations of an index (field_id, key, digest, const_raw, dtype) against its blobs."""
    missing = dangling(index, "key", "digest", blobs.withColumnRenamed("digest", "id"), "blob-missing")
    ranged = broken(index, "key", {"const-range": F.col("const_raw").isNotNull() & ~dtype_fits(F.col("const_raw"), F.col("dtype")), "const-or-blob": F.col("const_raw").isNull() == F.col("digest").isNull()})
    return missing.unionByName(ranged)


def capabilities(declared: DataFrame, requires: DataFrame) -> DataFrame:
    """Declared capabilities (id) that miss one that they require (id, needs)."""
    needed = declared.select("id").join(sorted_join(requires), "id")
    return dangling(needed.withColumn("_s", F.concat_ws(">", "id", "needs")).drop("id"), "_s", "needs", declared, "capability-missing").unionByName(repeated(declared, "id", "capability-duplicate"))

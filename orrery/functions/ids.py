"""Identities: birth addresses as bytes, and keys derived from them.

An address is a tag and numbers in unsigned LEB128, signed ones zigzagged first. Bytes are
columns of lower-case hex text, so that building them stays in generated code. Derived keys
are BLAKE3 under a context; contexts belong to the caller's format and are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from orrery.functions import codec
from orrery.functions.bits import unzigzag, zigzag

#: The tags of the address kinds; text forms of field ids.
TAGS = {"system_seed": 1, "body_in_system": 2, "free_object": 3, "fixture": 4}
FIELD = "^0x[0-9a-f]{8}$"


def _byte(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 2, "0"))


def uleb(x: Column) -> Column:
    """Hex of a 64-bit number, unsigned, seven bits a byte, the lowest first."""
    x = x.cast("long")
    parts = []
    for k in range(10):
        rest = F.shiftrightunsigned(x, 7 * k)
        more = F.lit(False) if k == 9 else F.shiftrightunsigned(x, 7 * (k + 1)) != 0
        one = _byte(rest.bitwiseAND(F.lit(0x7F)).bitwiseOR(F.when(more, 128).otherwise(0)))
        parts.append(one if k == 0 else F.when(rest != 0, one).otherwise(""))
    return F.concat(*parts)


def _numbers(text: str | None) -> list[int] | None:
    """The numbers in hex bytes; None where the last one is cut off, or one is longer than
    it has to be or than 64 bits."""
    try:
        raw = bytes.fromhex(text or "")
    except ValueError:
        return None
    out, now, n = [], 0, 0
    for b in raw:
        now |= (b & 0x7F) << (7 * n)
        n += 1
        if now >> 64 or n > 10 or b == 0 and n > 1:
            return None
        if b < 128:
            out.append(now - (1 << 64) if now >> 63 else now)
            now, n = 0, 0
    return out if out and not n else None


@F.pandas_udf(ArrayType(LongType()))
def uleb_read(texts: pd.Series) -> pd.Series:
    """array<long> of the numbers in a hex text, as 64 bits each; null if it is none."""
    return texts.map(_numbers)


def address(kind: Column, ix: Column, iy: Column, iz: Column, slot: Column, system: Column, role: Column, ordinal: Column, name: Column) -> Column:
    """Hex of a birth address; null for an unknown kind, an empty name or a number out of range."""
    region = F.concat(*(uleb(zigzag(c.cast("long"))) for c in (ix, iy, iz)), uleb(slot))
    u32 = lambda x: x.between(0, (1 << 32) - 1)
    text = F.lower(F.hex(F.encode(name, "utf-8")))
    in_system = F.rlike(system, F.lit("^[0-9a-f]{32}$")) & role.between(0, 255) & u32(ordinal)
    return (
        F.when((kind == "system_seed") & u32(slot), F.concat(F.lit("01"), region))
        .when((kind == "body_in_system") & in_system, F.concat(F.lit("02"), system, _byte(role), uleb(ordinal)))
        .when((kind == "free_object") & u32(slot), F.concat(F.lit("03"), region))
        .when((kind == "fixture") & (name != ""), F.concat(F.lit("04"), uleb(F.octet_length(name)), text))
    )


def with_region(df: DataFrame, text: str) -> DataFrame:
    """Adds (kind, ix, iy, iz, slot) of a system's or free object's address; null for any
    other bytes, overlong numbers and trailing bytes."""
    df = df.withColumn("_n", uleb_read(F.substring(text, 3, 1 << 20)))
    kind = F.when(F.startswith(text, F.lit("01")), "system_seed").when(F.startswith(text, F.lit("03")), "free_object")
    good = kind.isNotNull() & (F.size("_n") == 4) & F.try_element_at("_n", F.lit(4)).between(0, (1 << 32) - 1)
    df = df.withColumn("_n", F.when(good, F.col("_n"))).withColumn("kind", F.when(F.col("_n").isNotNull(), kind))
    return df.withColumns({c: unzigzag(F.col("_n")[k]) for k, c in enumerate(("ix", "iy", "iz"))} | {"slot": F.col("_n")[3]}).drop("_n")


def derived(context: str, chars: int = 64) -> Callable[[Column], Column]:
    """A function of hex columns: the first hex digits of the key that a context derives."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        known = texts[texts.notna()]
        found = codec.derive_key(context, [bytes.fromhex(t) for t in known])
        return pd.Series([d.hex()[:chars] for d in found], index=known.index, dtype=object).reindex(texts.index)

    return run


def object_id(universe: Column, address_: Column, context: str) -> Column:
    """``obj:`` and 32 digits for a universe's id and a birth address, both hex."""
    return F.concat(F.lit("obj:"), derived(context, 32)(F.concat(universe, address_)))


def _longs(context: str, messages: pd.Series) -> pd.Series:
    known = messages[messages.notna()]
    found = [int.from_bytes(d[:8], "little", signed=True) for d in codec.derive_key(context, known.tolist())]
    return pd.Series(found, index=known.index, dtype="Int64").reindex(messages.index)


def seed(object_: Column, context: str) -> Column:
    """A body's seed from its id in hex: the first 8 bytes of a key, the lowest first, as a long."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        return _longs(context, texts.map(lambda t: None if t is None else bytes.fromhex(t) + b"body"))

    return run(object_)


def subseed(seed_: Column, purpose: Column, context: str) -> Column:
    """The seed for a purpose, from another seed."""

    @F.pandas_udf(LongType())
    def run(seeds: pd.Series, purposes: pd.Series) -> pd.Series:
        pairs = zip(seeds, purposes, strict=True)
        made = [None if pd.isna(s) or p is None else int(s).to_bytes(8, "little", signed=True) + p.encode() for s, p in pairs]
        return _longs(context, pd.Series(made, index=seeds.index, dtype=object))

    return run(seed_, purpose)


def field_parts(text: Column) -> Column:
    """(capability, local) of a field id's text; null where it is none or a half is zero."""
    value = F.conv(F.substring(text, 3, 8), 16, 10).cast("long")
    high, low = F.shiftright(value, 16), value.bitwiseAND(F.lit(0xFFFF))
    return F.when(F.rlike(text, F.lit(FIELD)) & (high > 0) & (low > 0), F.struct(high.alias("capability"), low.alias("local")))

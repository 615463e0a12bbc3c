"""64-bit integer helpers as Column expressions; all safe under ANSI mode.

Unsigned 64-bit values live in BIGINT columns with the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def signed(value: int) -> int:
    """The signed 64-bit integer with the bits of an unsigned one."""
    return value - (1 << 64) if value >= 1 << 63 else value


def ukey(k: Column) -> Column:
    """Signed order of the result is unsigned order of ``k``."""
    return k.bitwiseXOR(F.lit(SIGN))


def spread(x: Column) -> Column:
    """Bits b of a number below 2^32 at bits 2 b."""
    x = x.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def compact(x: Column) -> Column:
    """Bits 2 b of a number at bits b."""
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return x


def trailing_zeros(k: Column) -> Column:
    """Trailing zero bits; null for 0 and for the sign bit alone (whose negation overflows)."""
    return F.when(~k.isin(0, SIGN), F.bit_count(k.bitwiseAND(-k) - 1).cast("int"))


def mul64(a: Column, b: int) -> Column:
    """a times a constant modulo 2^64: columns of 16-bit limb products, then carries."""
    part = [F.shiftrightunsigned(a, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    limb = [b >> (16 * k) & 0xFFFF for k in range(4)]
    out, carry = None, None
    for at in range(4):
        terms = [part[k] * F.lit(limb[at - k]) for k in range(at + 1)]
        total = sum(terms[1:], terms[0])
        total = total if carry is None else total + carry
        low = F.shiftleft(total.bitwiseAND(F.lit(0xFFFF)), 16 * at)
        out = low if out is None else out.bitwiseOR(low)
        carry = F.shiftrightunsigned(total, 16)
    return out


def mul64_text(a: str, b: int) -> str:
    """``mul64`` of a column's name as SQL text, which is built faster than Column objects."""
    total, out = "", []
    for at in range(4):
        terms = [f"(shiftrightunsigned({a}, {16 * k}) & 65535L) * {b >> (16 * (at - k)) & 0xFFFF}L" for k in range(at + 1)]
        total = " + ".join(terms + ([f"shiftrightunsigned({total}, 16)"] if total else []))
        out.append(f"shiftleft(({total}) & 65535L, {16 * at})")
    return " | ".join(out)


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2^64."""
    a, b = a.cast("long"), b.cast("long")
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1)))


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these columns handed through a generator of one row.

    Filters on them, and the null checks that joins infer, stop there: written out below,
    they would repeat the columns' nested definitions at every reference."""
    return df.select(*(c for c in df.columns if c not in names), F.inline(F.array(F.struct(*names))))

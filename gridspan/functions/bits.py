"""Integer codes as Column expressions. Spark integers are signed and overflow throws, so 32-bit
arithmetic runs on bigint and is masked after every step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def _l(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("long")


def low32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK32))


def mul32(c: Column, k: int) -> Column:
    """The low 32 bits of a product; k is below 2**31."""
    return low32(low32(_l(c)) * F.lit(k))


def zigzag(d: Column) -> Column:
    d = _l(d)
    return F.when(d >= 0, 2 * d).otherwise(-2 * d - 1)


def unzigzag(z: Column) -> Column:
    z = _l(z)
    return F.when(z.bitwiseAND(F.lit(1)) == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z + 1, 1))


def bit_length(v: Column) -> Column:
    """Bits of a positive integer, from its binary text: no floating logarithm."""
    return F.length(F.bin(_l(v)))


def value_symbol(v: Column) -> Column:
    """struct(sym, bits, mantissa): 0 to 11 directly, then a symbol for each power of two."""
    v = _l(v)
    k = bit_length(v) - 1
    small = v < 12
    power = F.expr("1L") * F.pow(F.lit(2.0), k).cast("long")
    return F.struct(
        F.when(small, v).otherwise((k + 9).cast("long")).alias("sym"),
        F.when(small, F.lit(0)).otherwise(k).cast("long").alias("bits"),
        F.when(small, F.lit(0).cast("long")).otherwise(v - power).alias("mantissa"),
    )


def spread(v: Column, bits: int = 14) -> Column:
    """The bits of v at the even places."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(_l(v), b).bitwiseAND(F.lit(1).cast("long")), 2 * b))
    return out


def morton(x: Column, z: Column, bits: int = 14) -> Column:
    return spread(x, bits).bitwiseOR(F.shiftleft(spread(z, bits), 1))


LEVEL_UNIT, ROW_UNIT = 0x4000000, 0x2000


def chunk_key(level: Column, cx: Column, cz: Column) -> Column:
    return _l(level) * F.lit(LEVEL_UNIT) + _l(cz) * F.lit(ROW_UNIT) + _l(cx)


def key_level(key: Column) -> Column:
    return F.floor(key / F.lit(LEVEL_UNIT)).cast("long")


def key_x(key: Column) -> Column:
    return F.pmod(key, F.lit(ROW_UNIT))


def key_z(key: Column) -> Column:
    return F.floor(F.pmod(key, F.lit(LEVEL_UNIT)) / F.lit(ROW_UNIT)).cast("long")


def parent_key(key: Column) -> Column:
    return chunk_key(key_level(key) + 1, F.shiftright(key_x(key), 1), F.shiftright(key_z(key), 1))


def cell_hash(ix: Column, iz: Column, seed: int = 0) -> Column:
    """32-bit hash of a cell, for deterministic choices (fixed constants)."""
    h = mul32(ix, 73856093).bitwiseXOR(mul32(iz, 19349663)).bitwiseXOR(F.lit((seed * 83492791) & MASK32))
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = mul32(h, 0x5BD1E995)
    return h.bitwiseXOR(F.shiftright(h, 15))


def lattice_hash(ix: Column, iz: Column, seed: int) -> Column:
    """A number in [0, 1) for a lattice point (fixed constants)."""
    h = mul32(ix, 374761393).bitwiseXOR(mul32(iz, 668265263)).bitwiseXOR(F.lit((seed * 1442695041) & MASK32))
    h = mul32(h.bitwiseXOR(F.shiftright(h, 13)), 1274126177)
    return h.bitwiseXOR(F.shiftright(h, 16)) / F.lit(4294967296.0)


def floor_div(a: Column, k: int) -> Column:
    """Integer division towards minus infinity."""
    return F.floor(a / F.lit(k)).cast("long")

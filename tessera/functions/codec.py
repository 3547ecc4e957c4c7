"""Typed reads of byte columns, scaling between raw and physical values, and their statuses.

All functions are column expressions. Bytes are decoded through their hexadecimal
text; an out-of-range read is null, and ``or_sentinel`` gives the sentinel instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = -99999


def read_unsigned(data: Column, offset: Column | int, width: int, big_endian: bool = False) -> Column:
    """An unsigned integer of 1, 2, 4 or 8 bytes as a decimal (8 bytes) or a long."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    order = range(width) if big_endian else range(width - 1, -1, -1)
    digits = F.concat(*(F.hex(F.substring(data, at + k + 1, F.lit(1))) for k in order))
    value = F.conv(digits, 16, 10).cast("decimal(20,0)" if width == 8 else "long")
    return F.when((at >= 0) & (at + width <= F.length(data)), value)


def read_signed(data: Column, offset: Column | int, width: int, big_endian: bool = False) -> Column:
    """A two's-complement integer of 1, 2, 4 or 8 bytes as a long."""
    value, half, whole = read_unsigned(data, offset, width, big_endian), 1 << (8 * width - 1), 1 << (8 * width)
    if width == 8:
        kind = "decimal(20,0)"
        return F.when(value >= F.lit(str(half)).cast(kind), value - F.lit(str(whole)).cast(kind)).otherwise(value).cast("long")
    return F.when(value >= half, value - whole).otherwise(value)


def read_float(data: Column, offset: Column | int, width: int = 4, big_endian: bool = False) -> Column:
    """An IEEE 754 number of 4 or 8 bytes, from its sign, exponent and fraction."""
    fraction_bits, bias = (23, 127) if width == 4 else (52, 1023)
    bits = read_signed(data, offset, width, big_endian)
    fraction = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double")
    exponent = F.shiftright(bits, fraction_bits).bitwiseAND(F.lit(2 * bias + 1))
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    small = fraction * F.pow(F.lit(2.0), F.lit(float(1 - bias - fraction_bits)))
    usual = (1 + fraction / float(1 << fraction_bits)) * F.pow(F.lit(2.0), exponent - bias)
    odd = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, small).when(exponent == 2 * bias + 1, odd).otherwise(usual)


def or_sentinel(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float(SENTINEL)))


def linear(raw: Column, a: float, b: float) -> Column:
    """phys = a * raw + b."""
    return raw * F.lit(float(a)) + F.lit(float(b))


def linear_inverse(phys: Column, a: float, b: float) -> Column:
    """raw = (phys - b) / a, null for a = 0."""
    return F.try_divide(phys - F.lit(float(b)), F.lit(float(a)))


def rational_to_raw(p: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """raw = (a p² + b p + c) / (d p² + e p + f), 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a * p * p + b * p + c, d * p * p + e * p + f), F.lit(0.0))


def rational_to_phys(raw: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """The inverse where a = d = 0, else the same quotient of quadratics."""
    if a == d == 0:
        return F.coalesce(F.try_divide(c - raw * f, raw * e - b), F.lit(0.0))
    return rational_to_raw(raw, a, b, c, d, e, f)


def encode(raw: Column, width: int, signed: bool) -> Column:
    """``value, status`` of a number stored as an integer: rounded half away from zero, then clamped; null if it isn't finite."""
    low, high = (-(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1) if signed else (0, (1 << (8 * width)) - 1)
    finite = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != float("inf"))
    rounded = F.round(F.when(finite, raw))
    status = F.when(~finite, "NonFinite").when((rounded < low) | (rounded > high), "Clamped").otherwise("Ok")
    held = F.when(rounded.isNotNull(), F.least(F.greatest(rounded, F.lit(float(low))), F.lit(float(high))))
    return F.struct(held.cast("long").alias("value"), status.alias("status"))


def hex_text(value: Column, width: int) -> Column:
    """The last ``2 * width`` hexadecimal digits of an integer."""
    return F.right(F.lpad(F.hex(value), 16, "0"), F.lit(2 * width))


def precision_of(a: float, fmt: str | None = None) -> int:
    """Decimals to show: from ``%w.p``, else from the step's size, 0 to 3."""
    import math
    import re

    if fmt and (m := re.fullmatch(r"%\d*\.(\d+).*", fmt)):
        return int(m[1])
    return max(0, min(3, math.floor(-math.log10(abs(a))))) if a else 0


def crc_identity(data: Column) -> Column:
    """The top 24 bits of CRC-32 without its final inversion, as six hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.shiftright(F.crc32(data).bitwiseXOR(F.lit(4294967295)), 8).bitwiseAND(F.lit(16777215))), 6, "0"))


def byte_sum(data: Column) -> Column:
    """The sum of all bytes modulo 65536."""
    each = F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x).bitwiseAND(F.lit(65535))


def trouble_code(code: Column) -> Column:
    """A diagnostic code from 16 bits: letter by the top two, then four hexadecimal digits."""
    letter = F.element_at(F.array(*map(F.lit, "PCBU")), (F.shiftright(code, 14).bitwiseAND(F.lit(3)) + 1).cast("int"))
    return F.concat(letter, F.shiftright(code, 12).bitwiseAND(F.lit(3)).cast("string"), hex_text(code.bitwiseAND(F.lit(4095)), 2).substr(2, 3))
